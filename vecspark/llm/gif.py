"""Media columns: texts stored as animated GIFs, and GIFs read back as timed frames.

The writer compresses 8-bit samples by LZW.  The reader takes any GIF: code
streams of any minimum code size, global and local palettes, interlacing,
transparency, and all ways of disposing of a frame.

LZW codes widen at places that follow from the number of codes since the last
clear code alone.  So both directions handle the codes of a whole stretch up to
the next clear code at once, as arrays; only the table of strings is built one
code after the other.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_arrow

MOST_CODES = 4096
WIDTH = 64
#: Rows of a frame at most, so that a frame has 64 KiB at most.
FRAME_ROWS = 1024
#: Hundredths of a second that a frame is shown.
DELAY = 4
HEADERS = (b"GIF87a", b"GIF89a")
GREYS = bytes(v for k in range(256) for v in (k, k, k))


def code_widths(size: int, begin: int, count: int) -> np.ndarray:
    """Bits of ``count`` codes, from the one that is ``begin`` codes after the last clear code."""
    widths = _widths(size)
    return widths[begin : begin + count] if begin + count <= len(widths) else np.append(widths[begin:], np.full(begin + count - max(begin, len(widths)), 12))


@functools.cache
def _widths(size: int) -> np.ndarray:
    table = (1 << size) + 2 + np.maximum(np.arange(MOST_CODES) - 1, 0)
    return np.clip(np.frexp(table)[1], size + 1, 12).astype(np.int64)


def lzw_compress(samples: bytes, size: int = 8) -> bytes:
    """The code stream of samples of ``size`` bits (8 at most)."""
    clear = 1 << size
    stretches: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    free, code = clear + 2, -1
    for sample in samples:
        if code < 0:
            code = sample
            continue
        known = table.get(key := code << 8 | sample)
        if known is not None:
            code = known
            continue
        codes.append(code)
        if free < MOST_CODES:
            table[key] = free
            free += 1
        else:
            stretches.append(codes)
            codes, table, free = [], {}, clear + 2
        code = sample
    if code >= 0:
        codes.append(code)
    stretches.append(codes)
    values, widths = [np.array([clear])], [np.array([size + 1])]
    longest = code_widths(size, 0, max(map(len, stretches)) + 1)
    for k, codes in enumerate(stretches):
        values.append(np.array([*codes, clear if k + 1 < len(stretches) else clear + 1]))
        widths.append(longest[: len(codes) + 1])
    return _pack(np.concatenate(values), np.concatenate(widths))


def _pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Bits of the values one after the other, lowest first."""
    ends = widths.cumsum()
    begins = ends - widths
    spread = values << (begins & 7)
    out = np.zeros(int(ends[-1] + 7) // 8 + 2, np.uint8)
    wide = int(widths.min()) > 8  # then no two values begin in the same byte
    for k in range(3):
        at, part = (begins >> 3) + k, (spread >> (8 * k)).astype(np.uint8)
        if wide:
            out[at] |= part
        else:
            np.bitwise_or.at(out, at, part)
    return out[: int(ends[-1] + 7) // 8].tobytes()


def lzw_expand(stream: bytes, size: int, most: int) -> bytes:
    """Up to ``most`` samples of a code stream; it may end early."""
    clear, padded = 1 << size, np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    start = [bytes([k]) for k in range(clear)] + [b"", b""]
    parts: list[bytes] = []
    bit, since, made = 0, 0, 0
    table, prev = start.copy(), b""
    while made < most:
        ends = code_widths(size, since, min(MOST_CODES, (8 * len(stream) - bit) // (size + 1))).cumsum() + bit
        ends = ends[ends <= 8 * len(stream)]
        if not len(ends):
            break
        begins = np.concatenate(([bit], ends[:-1]))
        at = begins >> 3
        codes = (padded[at] | padded[at + 1] << 8 | padded[at + 2] << 16) >> (begins & 7) & ((1 << ends - begins) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(marks[0]) if len(marks) else len(codes)
        for code in codes[:stop].tolist():
            if code < len(table):
                text = table[code]
            elif prev:
                text = prev + prev[:1]
            else:
                raise ValueError("a code stands before its string")
            if prev and len(table) < MOST_CODES:
                table.append(prev + text[:1])
            parts.append(text)
            prev = text
        parts = [b"".join(parts)]
        made = len(parts[0])
        if len(marks) and codes[stop] == clear + 1:
            break
        if len(marks):
            bit, since, table, prev = int(ends[stop]), 0, start.copy(), b""
        else:
            bit, since = int(ends[-1]), since + stop
    return b"".join(parts)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def write_gif(samples: bytes, palette: bytes = GREYS) -> bytes:
    """An animation whose frames hold ``samples`` (a positive multiple of 64 bytes) row by row."""
    height = min(len(samples) // WIDTH, FRAME_ROWS)
    out = [HEADERS[1], struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), palette]
    for k in range(0, len(samples), WIDTH * FRAME_ROWS):
        part = samples[k : k + WIDTH * FRAME_ROWS]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0))
        out.append(b"\x08" + _blocks(lzw_compress(part)))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """What a frame stores, and what is to be seen while it is shown (RGBA)."""

    left: int
    top: int
    delay: int
    samples: np.ndarray
    seen: np.ndarray | None


def read_gif(data: bytes, compose: bool = True) -> tuple[int, int, list[Frame]]:
    """Width, height and frames; without ``compose`` the frames have stored samples only."""
    if data[:6] not in HEADERS:
        raise ValueError("this is no GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def colours(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 3 << (flags & 7) + 1
        at += n
        return np.frombuffer(data, np.uint8, n, at - n).reshape(-1, 3)

    def block() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    shared = colours(flags)
    canvas = np.zeros((height, width), "<u4")
    frames: list[Frame] = []
    disposal, delay, clear = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label, at = data[at], at + 1
            body = block()
            if label == 0xF9 and len(body) >= 4:
                flags, delay, colour = struct.unpack_from("<BHB", body)
                disposal, clear = flags >> 2 & 7, colour if flags & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"no block is of kind {kind}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        own = colours(flags)
        size, at = data[at], at + 1
        raw = lzw_expand(block(), size, w * h)
        samples = np.frombuffer(raw.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        seen = None
        if compose:
            table = own if own is not None else shared if shared is not None else np.zeros((0, 3), np.uint8)
            full = np.full((256, 4), (0, 0, 0, 255), np.uint8)
            full[: len(table), :3] = table
            colour_of = full.view("<u4").ravel()
            if clear is None and disposal < 2 and (left, top, h, w) == (0, 0, height, width):
                canvas = colour_of[samples]
                seen = canvas
            else:
                shown = samples[: max(0, height - top), : max(0, width - left)]
                area = slice(top, top + shown.shape[0]), slice(left, left + shown.shape[1])
                before, canvas = canvas, canvas.copy()
                visible = np.ones(shown.shape, bool) if clear is None else shown != clear
                canvas[area] = np.where(visible, colour_of[shown], canvas[area])
                seen = canvas
                if disposal == 2:
                    canvas = canvas.copy()
                    canvas[area] = 0
                elif disposal == 3:
                    canvas = before
            seen = seen.view(np.uint8).reshape(height, width, 4)
        frames.append(Frame(left, top, delay, samples, seen))
        disposal, delay, clear = 0, 0, None
    return width, height, frames


def histogram(seen: np.ndarray) -> list[int]:
    """Pixels of a frame by colour: two bits of red, green and blue, and last those that are transparent."""
    cells = seen[..., 0].astype(np.int64) >> 6 << 4 | seen[..., 1].astype(np.int64) >> 6 << 2 | seen[..., 2].astype(np.int64) >> 6
    cells[seen[..., 3] == 0] = 64
    return np.bincount(cells.ravel(), minlength=65).tolist()


def _extended(table: DataFrame, drop: list[str], new: list[T.StructField]) -> T.StructType:
    names = {f.name for f in new} | set(drop)
    return T.StructType([f for f in table.schema.fields if f.name not in names] + new)


def store_texts(docs: DataFrame) -> DataFrame:
    """The documents with ``n_bytes`` and ``media`` (a GIF) in place of ``text``.

    The text's UTF-8 bytes are filled up with zero bytes to a positive multiple
    of 64.  Null texts are stored like empty ones.  Other columns stay, except
    that ones named like a new one are replaced.
    """
    schema = _extended(docs, ["text"], [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [(t.as_py() or "").encode() for t in part.column("text")]
                media = [write_gif(t.ljust(max(1, -(-len(t) // 64)) * 64, b"\0")) for t in texts]
                added = [pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in schema.names[:-2]] + added, schema.names)

    return docs.transform(in_arrow, store, schema)


def frames(media: DataFrame) -> DataFrame:
    """One row for each frame of the GIFs in ``media``: ``frame, begin_ms, delay_ms, width, height, samples, colours``.

    ``samples`` has the stored samples, ``colours`` counts the pixels that are
    seen by colour (see ``histogram``).  A null in ``media`` has no frames.
    Other columns stay, except ones named like a new one.
    """
    new = [T.StructField(c, T.IntegerType()) for c in ("frame", "begin_ms", "delay_ms", "width", "height")]
    new += [T.StructField("samples", T.BinaryType()), T.StructField("colours", T.ArrayType(T.IntegerType()))]
    schema = _extended(media, ["media"], new)
    kinds = [pa.int32()] * 5 + [pa.binary(), pa.list_(pa.int32())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column("media")[k].as_py()
                rows, begin = [], 0
                for n, x in enumerate(read_gif(data)[2] if data is not None else []):
                    rows.append((n, begin, 10 * x.delay, x.samples.shape[1], x.samples.shape[0], x.samples.tobytes(), histogram(x.seen)))
                    begin += 10 * x.delay
                kept = [batch.column(c).slice(k, 1).take(pa.array([0] * len(rows), pa.int64())) for c in schema.names[: -len(new)]]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 7, kinds)], schema.names)

    return media.transform(in_arrow, read, schema)


def media_columns(media: DataFrame) -> DataFrame:
    """Digests of the GIFs in ``media`` and of the samples read back from them.

    ``feature`` has the number of frames, the milliseconds they are shown and
    the pixels by grey level (64 levels wide), summed over the frames.  Where
    ``media`` is null, all new columns are.
    """
    new = [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
    new += [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
    schema = _extended(media, ["media"], new)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("media"):
                data = value.as_py()
                if data is None:
                    rows.append((None,) * 6)
                    continue
                shown = read_gif(data)[2]
                payload = b"".join(x.samples.tobytes() for x in shown)
                grey = np.sum([np.bincount(x.seen[: x.samples.shape[0], :, 0].ravel() >> 6, minlength=4) for x in shown], 0)
                feature = f"{len(shown)}:{sum(10 * x.delay for x in shown)}:{','.join(map(str, grey))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            added = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema.names[:-6]] + added, schema.names)

    return media.transform(in_arrow, digest, schema)


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(documents(spark, sf_dir).select("doc_id", "text"))
    return media_columns(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
