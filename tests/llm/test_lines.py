import random

from tables import odd_rows, table

from vecspark.llm import lines


def brute(rows):
    """Kept lines of each row, by comparing every pair of lines."""
    all_lines = [(i, k, line.split(), t) for i, t in rows for k, line in enumerate(t.split("\n"))]

    def near(a, b):
        short, long = sorted((a, b), key=len)
        if len(short) < lines.NEAR_WORDS:
            return False
        if len(short) == len(long):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    first = {}
    for i, k, words, _ in all_lines:
        if words:
            key = tuple(words)
            first[key] = min(first.get(key, (i, k)), (i, k))
    gone = {a for a in first for b in first if first[b] < first[a] and near(list(a), list(b))}
    kept = {}
    for i, k, words, t in all_lines:
        stays = not words or (first[tuple(words)] == (i, k) and tuple(words) not in gone)
        kept.setdefault(i, []).append(t.split("\n")[k] if stays else None)
    return {i: "\n".join(x for x in own if x is not None) for i, own in kept.items()}


def test_against_brute_force(spark):
    random.seed(11)
    seeds = [[random.choice("abcdefgh") for _ in range(random.choice((3, 8, 9, 12, 40, 70)))] for _ in range(25)]

    def line():
        words = list(random.choice(seeds))
        for _ in range(random.choice((0, 0, 1, 1, 2))):
            at = random.randrange(len(words))
            what = random.random()
            words[at : at + (what < 0.7)] = [] if what < 0.35 else [random.choice("xyz")]
        return random.choice((" ", "  ", "\t")).join(words)

    rows = [(i, "\n".join(line() if random.random() < 0.9 else "" for _ in range(random.randrange(1, 9)))) for i in range(60)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(table(spark, rows)).collect()}
    want = brute(rows)
    for i, text in rows:
        assert got[i]["text"] == want[i], i
        assert got[i]["n_lines"] == text.count("\n") + 1
    assert any(want[i] != t for i, t in rows)


def test_insertions_at_every_place(spark):
    words = [f"w{k}" for k in range(70)]
    rows = [(0, " ".join(words))]
    rows += [(1 + k, " ".join(words[:k] + ["new"] + words[k:])) for k in range(71)]
    rows += [(100 + k, " ".join(words[:k] + words[k + 1 :])) for k in range(70)]
    rows += [(200 + k, " ".join(words[:k] + ["other"] + words[k + 1 :])) for k in range(70)]
    got = lines.dedup_lines(table(spark, rows)).where("n_kept > 0").collect()
    assert [r["doc_id"] for r in got] == [0]


def test_odd_tables(spark):
    docs = table(spark, odd_rows()).selectExpr("*", "1 as n_kept", "'k' as line", "2 as place")
    got = lines.dedup_lines(docs).collect()
    assert len(got) == len(odd_rows())
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["text"] for r in by_id[1]] == [odd_rows()[0][1]] * 2  # equal rows are one document
    assert by_id[2][0]["text"] is None and by_id[2][0]["n_lines"] == 0
    assert by_id[3][0]["text"] == "" and by_id[3][0]["n_kept"] == 1
    assert by_id[4][0]["n_kept"] == 3 and by_id[4][0]["place"] == 2
    assert lines.dedup_lines(docs.where("false")).count() == 0
