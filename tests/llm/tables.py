"""Tables that every operator has to take."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    full = [(i, t, "en", s[0] if s else "a", None if t is None else len(t)) for i, t, *s in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, repeated rows, ties."""
    long_line = " ".join(f"w{k % 977}" for k in range(30_000))
    return [
        (1, "one two three four five six seven eight nine ten", "a"),
        (1, "one two three four five six seven eight nine ten", "a"),
        (2, None, "a"),
        (3, "", None),
        (None, "no id here but some words to count, a b c d e f", None),
        (4, " \n\t \n", "b"),
        (5, long_line, "b"),
        (6, "x" * 100_000, "b"),
        (7, "naïve café ☃ 🙂 \x00 end", "c"),
    ]
