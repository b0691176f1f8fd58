import hashlib
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import odd_rows, table

from vecspark.llm import gif


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 8), st.binary(min_size=1, max_size=3000), st.integers(1, 40))
def test_lzw_round_trip(size, data, repeats):
    data = bytes(b % (1 << size) for b in data) * repeats
    assert gif.lzw_expand(gif.lzw_compress(data, size), size, len(data)) == data


def plain_expand(stream, size):
    """The textbook reader: one code after the other, bit by bit."""
    bits = int.from_bytes(stream, "little")
    clear, out, at = 1 << size, b"", 0
    table, width, prev = None, size + 1, b""
    while True:
        code = bits >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, prev = [bytes([k]) for k in range(clear)] + [b"", b""], size + 1, b""
            continue
        if code == clear + 1:
            return out
        text = table[code] if code < len(table) else prev + prev[:1]
        if prev and len(table) < 4096:
            table.append(prev + text[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out, prev = out + text, text


@pytest.mark.parametrize("kind", ["random", "text", "zeros"])
def test_against_a_plain_reader(kind):
    random.seed(1)
    data = {"random": random.randbytes(20000), "text": b"in the thane of the " * 900, "zeros": bytes(20000)}[kind]
    assert plain_expand(gif.lzw_compress(data), 8) == data


def test_codes_go_on_when_the_table_is_full():
    """A writer may leave a full table as it is; widths then stay at 12 bits."""
    codes = [256] + [k % 256 for k in range(6000)] + [257]
    widths = np.concatenate([[9], gif.code_widths(8, 0, 6001)])
    stream = gif._pack(np.array(codes), widths)
    assert gif.lzw_expand(stream, 8, 6000) == bytes(k % 256 for k in range(6000))


def image(samples, left, top, w, h, disposal=0, clear=None, palette=None, interlaced=False, delay=3):
    control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
    flags = (0x80 | 1 if palette else 0) | (0x40 if interlaced else 0)
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + (palette or b"") + b"\x02" + gif._blocks(gif.lzw_compress(bytes(samples), 2))


SHARED = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])


def animation(*images, w=4, h=4):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + SHARED + b"\x21\xfe\x03abc\0" + b"".join(images) + b"\x3b"


def test_palettes_transparency_and_disposal():
    first = image([1] * 16, 0, 0, 4, 4)
    kept = image([2, 0, 0, 2], 1, 1, 2, 2, disposal=1, clear=0)
    wiped = image([3] * 4, 0, 0, 2, 2, disposal=2)
    undone = image([2] * 4, 2, 2, 2, 2, disposal=3, palette=bytes([9, 9, 9] * 4))
    last = image([3], 3, 0, 1, 1)
    w, h, frames = gif.read_gif(animation(first, kept, wiped, undone, last))
    assert (w, h, len(frames), frames[0].delay) == (4, 4, 5, 3)
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    seen = [f.seen for f in frames]
    assert tuple(seen[1][1, 1]) == green and tuple(seen[1][1, 2]) == red  # colour 0 is clear
    assert tuple(seen[2][0, 0]) == blue and tuple(seen[3][0, 0]) == (0, 0, 0, 0)  # wiped behind frame 2
    assert tuple(seen[3][3, 3]) == (9, 9, 9, 255) and tuple(seen[4][3, 3]) == red  # undone behind frame 3
    assert tuple(seen[4][0, 3]) == blue
    assert gif.histogram(seen[3])[64] == 4


def test_interlaced_rows():
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    samples = [r % 4 for r in rows]
    _, _, frames = gif.read_gif(animation(image(samples, 0, 0, 1, 10, interlaced=True), w=1, h=10))
    assert frames[0].samples[:, 0].tolist() == [k % 4 for k in range(10)]


def test_no_gif():
    with pytest.raises(ValueError):
        gif.read_gif(b"PNG89a" + bytes(20))


def test_odd_tables(spark):
    docs = table(spark, odd_rows()).selectExpr("*", "1 as media", "'x' as feature", "2 as frame", "3 as width")
    stored = gif.store_texts(docs)
    rows = {r["doc_id"]: r for r in gif.media_columns(stored).collect()}
    assert gif.media_columns(stored).count() == len(odd_rows())
    for i, text, *_ in odd_rows():
        payload = (text or "").encode()
        payload = payload.ljust(max(64, -(-len(payload) // 64) * 64), b"\0")
        assert rows[i]["payload_bytes"] == len(payload) and rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    frames = gif.frames(stored).where("doc_id = 5").orderBy("frame").collect()
    long_text = next(t for i, t, *_ in odd_rows() if i == 5).encode()
    assert len(frames) == -(-len(long_text) // (64 * 1024)) and [f["begin_ms"] for f in frames] == [40 * k for k in range(len(frames))]
    assert b"".join(bytes(f["samples"]) for f in frames).rstrip(b"\0") == long_text
    assert all(sum(f["colours"]) == 64 * 1024 for f in frames[:-1])
    assert gif.media_columns(gif.store_texts(docs.where("false"))).count() == 0
    assert gif.frames(stored.selectExpr("doc_id", "cast(null as binary) as media")).count() == 0
    assert all(r["payload_bytes"] is None and r["feature"] is None for r in gif.media_columns(stored.selectExpr("doc_id", "cast(null as binary) as media")).collect())
