"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four kinds of identifiers are known by their form: e-mail addresses, IP
addresses, card numbers (Luhn) and telephone numbers.  They are seeds, and so
are secrets of one form, keys of 40 lower-case hexadecimal digits; secrets of
other forms have to be found.  What stands around a seed (the word or two words
before it, the word behind it, or a label such as ``mail=`` in the same word) is
a pattern.

Patterns and the values that they are found with make a graph.  In each round a
pattern's confidence in a kind is the share of that kind among its distinct
values, lowered for few values; trusted patterns pass their kind on to other
candidates that they are found with (words with a digit or an at sign, also a
spelt one, and groups of digits), and these values become known wherever they
occur.  What is found once stays.  Rounds go on until one finds nothing new.

Places are counted in code points.  They come from the lengths of the matches
and of the text between them, so no Python code sees a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, packed, small, stage, unpacked

KINDS = ("email", "ip", "card", "phone")
#: The forms of the kinds.  Matches are leftmost, longest, and don't overlap
#: within a kind; the guards in front only spare the search places inside a run
#: that cannot begin a match, and possessive repeats spare it going back.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the form to be looked for.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: The kind of seeds that is no base form.
SECRET = "secret"
SECRET_SEED = r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{40}$"
#: Words with a digit or an at sign, and groups of digits one space apart, may be identifiers yet unknown.
CANDIDATE = (
    r"(?<![^\x20\x09-\x0D])(?:[(+]?[0-9][0-9().+/-]*+(?:\x20\(?[0-9][0-9().+/-]*+)++(?![^\x20\x09-\x0D.,;:!?])"
    r"|[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+|[^\x20\x09-\x0D]+?[(\[](?:at|AT)[)\]][^\x20\x09-\x0D]++)"
)
#: A label in front of a value in the same word, and what is cut off a candidate's ends.
LABEL = r"^[\"'(\[{<]*([A-Za-z_.-]+[=:][\"']?)(?=.)"
OPENS = r"^[\"'\[{<]+"
ENDS = r"[^\p{L}\p{N}]+$"
#: Characters of the text before and behind a place that patterns are made of.
REACH = 64
#: A pattern is trusted if so many distinct values of a kind were found with it, and its confidence is as high.
SUPPORT, TRUST = 5, 0.75
#: Matches whose places are added up at a time.
RUN = 64
SPANS = "array<struct<start:int,end:int,value:string,kind:int>>"


def _matches(text: Column, form: str) -> Column:
    """``start, end, value`` of each match, in code points."""
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    gaps = F.split(text, form, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    both = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        return F.struct(end.alias("at"), F.array_append(state["done"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("done"))

    #: places are added up within runs of matches, then over the runs, so that no array grows by one element many times
    empty = F.struct(F.lit(0).alias("at"), none.alias("done"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(both, k * RUN + 1, F.lit(RUN)), empty, step))
    starts = F.aggregate(runs, F.array(F.lit(0)), lambda done, r: F.array_append(done, F.element_at(done, -1) + r["at"]))
    moved = F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), lambda r, by: F.transform(r["done"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value"))))
    return F.when(F.size(found) > 0, F.flatten(moved)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """True if the digits, every second one from the end doubled, sum up to a multiple of ten."""
    digits = F.reverse(_digits(value))
    odd = lambda k: F.substring(digits, k, F.lit(1)).cast("int")
    worth = lambda k: F.when(k % 2 == 1, odd(k)).otherwise(F.when(odd(k) > 4, odd(k) * 2 - 9).otherwise(odd(k) * 2))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda total, k: total + worth(k)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match has the digits that its kind asks for."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: (F.char_length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.nullif(F.ltrim(part, F.lit("0")), F.lit("")), F.lit("0")).try_cast("int") <= 255))
    n = F.char_length(_digits(value))
    if kind == "card":
        return n.between(16, 19) & _luhn(value)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _base(text: Column) -> Column:
    """All spans of the known forms: ``start, end, value, kind`` (its number), by kind and start."""
    def of_kind(k: int, kind: str) -> Column:
        held = F.filter(_matches(text, FORMS[kind]), lambda m: _holds(kind, m["value"]))
        spans = F.transform(held, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.lit(k).alias("kind")))
        return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast(SPANS))

    return F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)])


def _others(text: Column, base: Column) -> Column:
    """Candidates that no base span touches, without labels and the marks around them; seeds of secrets have their kind."""
    def cut(m: Column) -> Column:
        label = F.regexp_extract(m["value"], LABEL, 0)
        rest = F.substr(m["value"], F.char_length(label) + 1)
        opened = F.regexp_replace(rest, OPENS, "")
        value = F.regexp_replace(opened, ENDS, "")
        start = m["start"] + F.char_length(m["value"]) - F.char_length(opened)
        kind = F.when(value.rlike(SECRET_SEED), F.lit(len(KINDS)))
        return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"), kind.cast("int").alias("kind"))

    words = F.filter(F.transform(_matches(text, CANDIDATE), cut), lambda m: F.char_length(m["value"]) >= 5)
    free = F.filter(words, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.when(text.rlike(r"[0-9@]|[(\[](?:at|AT)[)\]]"), free).otherwise(F.array().cast(SPANS))


def _patterns(text: Column, m: Column, reach: int) -> Column:
    """What stands around a span."""
    before = F.lower(F.substring(text, F.greatest(m["start"] - reach, F.lit(0)) + 1, F.least(m["start"], F.lit(reach))))
    behind = F.lower(F.substring(text, m["end"] + 1, F.lit(reach)))
    known = [
        (F.lit("label "), F.regexp_extract(before, r"([a-z_.-]+[=:])[\"']?$", 1)),
        (F.lit("word "), F.regexp_extract(before, r"(\S+)\s+[(\[{<\"']*$", 1)),
        (F.lit("words "), F.regexp_extract(before, r"(\S+\s+\S+)\s+[(\[{<\"']*$", 1)),
        (F.lit("behind "), F.regexp_extract(behind, r"^[.,;:!?\"')\]}>]*\s+(\S+)", 1)),
    ]
    return F.filter(F.array(*[F.when(F.length(x) > 0, F.concat(name, x)) for name, x in known]), lambda p: p.isNotNull())


def scored_patterns(links: DataFrame, known: DataFrame) -> DataFrame:
    """Trusted ``pattern, kind, confidence``, of ``links`` (pattern, value) and ``known`` (value, kind).

    The confidence is the share of the kind's values, less one deviation of an
    estimate from as many values.
    """
    seen = links.join(known, "value", "left")
    every = range(len(KINDS) + 1)
    counts = seen.groupBy("pattern").agg(F.count("*").alias("all"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n{k}") for k in every])
    rows = counts.select("pattern", "all", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n{k}").alias("n")) for k in every])).alias("x")).select("pattern", "all", "x.*").where(F.col("n") >= SUPPORT)
    share = F.col("n") / F.col("all")
    rows = rows.withColumn("confidence", share - F.sqrt((share * (1 - share) + 1 / F.col("all")) / F.col("all")))
    return rows.where(F.col("confidence") >= TRUST).select("pattern", "kind", "confidence")


def _bootstrap(mentions: DataFrame) -> DataFrame:
    """``value, kind`` of the values found through patterns, beyond the seeds.

    Every round adds values that are not known yet or is the last one, so the
    rounds end at a fixed point.
    """
    links = stage(mentions.select(F.explode("patterns").alias("pattern"), "value").distinct(), "pii-links", few=True)
    seeds = stage(mentions.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")), "pii-seeds", few=True)
    new = None
    while True:
        known = seeds if new is None else seeds.unionByName(new)
        trusted = stage(scored_patterns(links, known), "pii-patterns", few=True)
        found = links.join(small(trusted), "pattern").join(known.select("value"), "value", "left_anti")
        found = found.groupBy("value", "kind").agg((1 - F.product(1 - F.col("confidence"))).alias("belief"))
        best = found.groupBy("value").agg(F.max(F.struct("belief", -F.col("kind"))).alias("best")).select("value", (-F.col("best.col2")).alias("kind"))
        more = stage(best, "pii-found", few=True)
        if not more.limit(1).count():
            return more if new is None else new
        new = more if new is None else stage(new.unionByName(more), "pii-known", few=True)


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The documents without their texts, with ``spans``: ``kind, start, end, base`` by kind and start.

    ``docs`` needs ``doc_id`` and ``text``.  Null and empty texts have no spans.
    The kinds are the four base ones and, behind them, ``secret``.  Patterns are
    made of ``reach`` characters on either side of a place.
    A span found through patterns never touches a base span; it stands behind
    the base spans of its kind that begin before it.  Rows with equal id and
    text get equal spans, null ids too.  Other columns stay, except one named
    ``spans``.  An empty table gives an empty result.
    """
    columns, docs = docs.columns, packed(docs, "doc_id", "text")
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("text_key", text_key).withColumn("base", F.coalesce(_base(F.col("text")), F.array().cast(SPANS)))
    rows = rows.withColumn("others", F.coalesce(_others(F.col("text"), F.col("base")), F.array().cast(SPANS)))
    mention = F.transform(F.concat("base", "others"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), m["value"].alias("value"), _patterns(F.col("text"), m, reach).alias("patterns")))
    rows = stage(rows.withColumn("mentions", mention).select("doc_id", "_others", "text_key", "mentions"), "pii-documents")
    mentions = rows.select("doc_id", "text_key", F.explode("mentions").alias("m")).select("doc_id", "text_key", "m.*")
    values = _bootstrap(mentions).withColumnRenamed("kind", "found_kind")
    more = mentions.where("kind is null").join(small(values), "value").groupBy("doc_id", "text_key")
    more = stage(more.agg(F.collect_set(F.struct(F.col("found_kind").alias("kind"), "start", "end", F.lit(False).alias("base"))).alias("more")).withColumnsRenamed({"doc_id": "more_id", "text_key": "more_key"}), "pii-more", few=True)
    base = F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), (m["kind"] < len(KINDS)).alias("base")))
    out = rows.join(small(more), F.col("doc_id").eqNullSafe(F.col("more_id")) & (F.col("text_key") == F.col("more_key")), "left")
    spans = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean>>"))))
    names = F.array(*map(F.lit, [*KINDS, SECRET]))
    named = F.transform(spans, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return unpacked(out.withColumn("spans", named), [c for c in columns if c != "text"], "spans")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of kinds and the digest are those of the base spans; ``spans`` has all, and ``n_spans`` is their number."""
    found = find(documents(spark, sf_dir).select("doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [number(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
