import random
import re

from tables import odd_rows, table

from vecspark.llm import pii

#: The forms by their definitions.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in FORMS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def spans(rows):
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in rows}


def test_base_spans(spark):
    random.seed(3)
    parts = ["1", "25", "0", ".", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "_", "é", "🙂", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "300.1.1.1", "a@b.c", "x.y@z.org.uk", "+1 (555) 123-4567", "\n", "999"]
    texts = ["".join(random.choices(parts, k=random.randrange(40))) for _ in range(1500)]
    texts += ["9" * 30000, "a" * 30000 + "@", "1 " * 10000, "+" * 500, "1." * 3000 + "1"]
    got = spans(pii.find(table(spark, list(enumerate(texts)))).collect())
    for k, t in enumerate(texts):
        assert got[k] == brute(t), t[:200]


def test_patterns_discover_identifiers(spark):
    """Numbers of an unknown form stand where card numbers stand; trusted words before them tell."""
    random.seed(1)

    def card():
        while not holds("card", c := "4" + "".join(random.choices("0123456789", k=15))):
            pass
        return c

    rows = [(k, f"some words charged to account {card()} on file {k}a{k} today") for k in range(60)]
    rows += [(100 + k, f"other words charged to account AC-{k}77x{k} on file today") for k in range(3)]
    rows += [(200 + k, f"the room {k}b2c has a number") for k in range(30)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(table(spark, rows)).collect()}
    for k in range(3):
        text = dict(rows)[100 + k]
        assert [(s["kind"], text[s["start"] : s["end"]], s["base"]) for s in got[100 + k]] == [("card", f"AC-{k}77x{k}", False)]
    assert all(not got[200 + k] for k in range(30))
    assert all([s["base"] for s in got[k]] == [True] for k in range(60))


def test_known_values_are_found_elsewhere(spark):
    rows = [(k, f"reach us by mail=user{k}@mail.example.org today") for k in range(30)]
    rows += [(100, "reach us by mail=user7(at)mail today"), (101, "nothing but user7(at)mail here")]
    got = {r["doc_id"]: [dict(rows)[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in pii.find(table(spark, rows)).collect()}
    assert got[100] == ["user7(at)mail"] and got[101] == ["user7(at)mail"]


def test_secrets_of_the_tables(spark):
    """Keys in lower case are seeds; those in capitals are found by what stands before them, with quotes and marks around them or not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = pii.find(docs).join(docs, "doc_id").collect()
    found = want = right = 0
    for r in got:
        text = r["text"] or ""
        keys = {(m.start(1), m.end(1)) for m in re.finditer(r"(?i)token = \"?([0-9a-f]{40})", text)}
        secrets = {(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "secret"}
        found, want, right = found + len(secrets), want + len(keys), right + len(keys & secrets)
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == brute(text)
    upper = [r for r in got if re.search(r"TOKEN = \"?[0-9A-F]{40}", r["text"] or "")]
    assert upper and all(any(s["kind"] == "secret" for s in r["spans"]) for r in upper)
    assert want > 100 and right == want and found == want


def test_rounds_go_on_to_a_fixed_point(spark):
    """What one round finds makes the next pattern trusted."""
    values = [[f"{k:x}".rjust(39, "a") + "7" for k in range(600)], [f"Z1x{k}Q" for k in range(100)], [f"Z2x{k}Q" for k in range(16)], [f"Z3x{k}Q" for k in range(2)]]
    texts = [f"here chain{link} {v} end{link} it" for link in range(3) for v in values[link] + values[link + 1]] + [f"other words {values[3][0]} stand", "other words Z4x4Q stand"]
    got = {r["doc_id"]: r["spans"] for r in pii.find(table(spark, list(enumerate(texts)))).collect()}
    assert all([s["kind"] for s in got[k]] == ["secret"] and not got[k][0]["base"] for k in range(len(texts) - 1))
    assert got[len(texts) - 1] == []


def test_groups_of_digits_and_spelt_signs(spark):
    rows = [(k, f"please call desk +49 30 1234{k:04d} soon") for k in range(30)] + [(100, "please call desk (030) 123 4567 soon"), (101, "please call desk 0301/99 88 77, soon")]
    rows += [(200 + k, f"mails to box user{k}@mail.example.org only") for k in range(30)] + [(300, "mails to box jane[at]mail only"), (301, "mails to box joe@mail only")]
    texts = dict(rows)
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.find(table(spark, rows)).collect()}
    assert got[100] == [("phone", "(030) 123 4567")] and got[101] == [("phone", "0301/99 88 77")]
    assert got[300] == [("email", "jane[at]mail")] and got[301] == [("email", "joe@mail")]


def test_odd_tables(spark):
    rows = [*odd_rows(), (50, "mail a@b.co, 10.0.0.1"), (50, "mail a@b.co, 10.0.0.1")]
    docs = table(spark, rows).selectExpr("*", "1 as kind", "'x' as value", "2 as mentions", "3 as text_key")
    got = pii.find(docs).collect()
    assert len(got) == len(rows)
    assert [len(r["spans"]) for r in got if r["doc_id"] == 50] == [2, 2]
    assert all(r["spans"] == [] for r in got if r["doc_id"] in (2, 3, 4, 6))
    assert pii.find(docs.where("false")).count() == 0
