"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line is its sequence of words.  Two lines are near when one word replaced,
put in or left out turns one into the other.  A line goes when an equal or near
line stands earlier, in order of document id and line number.

Equal lines are brought together by a 128-bit hash of their words; what remains
works on one row for each class.  For near lines every class would emit the
hash of each variant with one word left out; lines that share a variant are
near, and the earliest of those that share it is all that has to be compared.
So no group is ever expanded into pairs.

Few lines have near partners, so a cheaper join goes first.  Of two near lines,
either the first halves or the second halves are equal.  A class emits four
hashes of halves (as the line of equal length or the shorter one, and as the
longer one); only classes that meet another one go on, and they leave out words
only in the half that differs.  This loses no pair.

The hash of a variant is made of the hash of the words before the one left out
and that of the words behind it, both from sums over blocks of words, so very
long lines stay cheap.  Partners are compared word by word before a line goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, WORD, documents, packed, small, stage, unpacked

#: Words in the shorter of two lines, for the two to count as near; shorter lines have to be equal.
NEAR_WORDS = 8
#: Words summed up at a time.
BLOCK = 32


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, GAP), "")


def _text_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _first(words: Column, n: Column) -> Column:
    return F.slice(words, F.lit(1), n)


def _last(words: Column, n: Column) -> Column:
    return F.slice(words, F.size(words) - n + 1, n)


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row for each line with words: its place, its hashes and those of its halves."""
    texts = docs.select("doc_id", _text_key(docs).alias("text_key"), "text")  # the key once for a text, not for each of its lines
    lines = texts.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
    lines = lines.where(F.col("words").rlike(WORD)).withColumn("words", _words(F.col("words"))).withColumn("n", F.size("words"))

    def halves(n: Column, role: str) -> list[Column]:
        """Hashes of the halves that a line of n words must share, n being the line's own length or one less."""
        h = F.floor(n / 2).cast("int")
        known = n >= NEAR_WORDS
        return [F.when(known, F.xxhash64(n, F.lit(k), half)).alias(f"{role}{k}") for k, half in enumerate((_first(F.col("words"), h), _last(F.col("words"), n - h)))]

    return lines.select("doc_id", "line", "text_key", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"), "n", *halves(F.col("n"), "same"), *halves(F.col("n") - 1, "longer"))


def _meeting(classes: DataFrame) -> DataFrame:
    """Classes whose halves meet those of another, with what they meet: same0, same1 (a line of equal length), short0, short1 (a longer line), long0, long1 (a shorter line)."""
    keys = classes.select("k1", "k2", F.explode(F.array(*[F.struct(F.col(f"{role}{k}").alias("half"), F.lit(role).alias("role"), F.lit(k).alias("k")) for role in ("same", "longer") for k in (0, 1)])).alias("x")).select("k1", "k2", "x.*").where("half is not null")
    counts = keys.groupBy("half").agg(F.count(F.when(F.col("role") == "same", 1)).alias("same_n"), F.count(F.when(F.col("role") == "longer", 1)).alias("longer_n")).where("same_n > 1 or (same_n > 0 and longer_n > 0)")
    met = keys.join(counts, "half")
    role, k = F.col("role"), F.col("k")
    flags = {"same": (role == "same") & (F.col("same_n") > 1), "short": (role == "same") & (F.col("longer_n") > 0), "long": role == "longer"}
    return met.groupBy("k1", "k2").agg(*[F.max(on & (k == side)).alias(f"{name}{side}") for name, on in flags.items() for side in (0, 1)])


def _block_hashes(words: Column, from_end: bool) -> Column:
    """Hashes of the first 0, 32, 64 ... words, or of as many last words."""
    n = F.size(words)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), lambda b: b)
    cut = (lambda b: F.slice(words, n - (b + 1) * BLOCK + 1, F.lit(BLOCK))) if from_end else (lambda b: F.slice(words, b * BLOCK + 1, F.lit(BLOCK)))
    start = F.array(F.lit(0).cast("long"))
    return F.when(n < BLOCK, start).otherwise(F.aggregate(F.slice(blocks, F.lit(1), F.size(blocks) - 1), start, lambda done, b: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), cut(b))))))


def _variants(lines: DataFrame) -> DataFrame:
    """The variants of each line: ``key, kind, at`` beside the line's place and hashes.

    Kind 0 is for replaced words: words before and behind place ``at``.  For a
    word put in, the longer line (kind 2) leaves out the word at ``at``, and the
    shorter one (kind 1) is cut before place ``at``.
    """
    n = F.col("n")
    lines = lines.withColumn("heads", _block_hashes(F.col("words"), False)).withColumn("tails", _block_hashes(F.col("words"), True))

    def head(count: Column) -> Column:
        whole = F.floor(count / BLOCK).cast("int")
        return F.xxhash64(F.element_at("heads", whole + 1), F.slice("words", whole * BLOCK + 1, count - whole * BLOCK))

    def tail(count: Column) -> Column:
        whole = F.floor(count / BLOCK).cast("int")
        return F.xxhash64(F.element_at("tails", whole + 1), F.slice("words", n - count + 1, count - whole * BLOCK))

    def places(first: Column, last: Column, half: Column, met0: str, met1: str) -> Column:
        """Places from first to last, without a half of them if only the other half can differ; the first ``half`` words are equal under met0."""
        low = F.when(F.col(met1), first).otherwise(half + 1)
        high = F.when(F.col(met0), last).otherwise(half + 1)
        return F.when((F.col(met0) | F.col(met1)) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def emit(kind: int, size: Column, cuts: Column, behind: int) -> Column:
        return F.transform(cuts, lambda i: F.struct(F.xxhash64(F.lit(min(kind, 1)), size, i, head(i - 1), tail(n - i + behind)).alias("key"), F.lit(kind).alias("kind"), i.alias("at")))

    one = F.lit(1)
    half, shorter_half = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    found = F.concat(
        emit(0, n, places(one, n, half, "same0", "same1"), 0),
        emit(1, n, places(one, n + 1, half, "short0", "short1"), 1),
        emit(2, n - 1, places(one, n, shorter_half, "long0", "long1"), 0),
    )
    return lines.select("k1", "k2", "place", F.explode(found).alias("v")).select("k1", "k2", "place", "v.key", "v.kind", "v.at")


def _near(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes (k1, k2) that have a near line at an earlier place."""
    meeting = _meeting(classes).join(classes.select("k1", "k2", "place"), ["k1", "k2"])
    flags = [f"{name}{k}" for name in ("same", "short", "long") for k in (0, 1)]
    by_text = meeting.groupBy(F.col("place.doc_id").alias("at_id"), F.col("place.text_key").alias("at_text")).agg(F.collect_list(F.struct(F.col("place.line").alias("line"), "k1", "k2", "place", *flags)).alias("lines"))
    by_text = stage(by_text, "lines-by-text")
    texts = docs.select("doc_id", "text", _text_key(docs).alias("text_key")).join(small(by_text), F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_text")))
    texts = texts.select(F.split("text", "\n", -1).alias("all"), "lines")
    lines = texts.select("all", F.explode("lines").alias("x")).select("x.*", _words(F.element_at("all", F.col("x.line") + 1)).alias("words"))
    lines = lines.withColumn("n", F.size("words"))
    lines = stage(lines.dropDuplicates(["k1", "k2"]), "lines-words")

    variants = stage(_variants(lines), "lines-variants")
    who = F.struct("place", "k1", "k2")
    shared = variants.groupBy("key").agg(F.count("*").alias("members"), F.min(F.when(F.col("kind") < 2, who)).alias("base"), F.min(F.when(F.col("kind") == 2, who)).alias("longer")).where("members > 1")
    met = variants.join(shared, "key").withColumn("partner", F.when(F.col("kind") == 1, F.col("longer")).otherwise(F.col("base")))
    met = met.where(F.col("partner").isNotNull() & (F.col("partner.place") < F.col("place")))
    pairs = met.select("k1", "k2", "kind", "at", F.col("partner.k1").alias("p1"), F.col("partner.k2").alias("p2")).distinct()

    own = pairs.join(lines.select("k1", "k2", "words"), ["k1", "k2"])
    other = lines.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("words").alias("others"))
    both = own.join(other, ["p1", "p2"])

    def without(words: Column) -> Column:
        return F.concat(F.slice(words, F.lit(1), F.col("at") - 1), F.slice(words, F.col("at") + 1, F.size(words) - F.col("at")))

    w, o = F.col("words"), F.col("others")
    equal = F.when(F.col("kind") == 0, without(w) == without(o)).when(F.col("kind") == 1, w == without(o)).otherwise(without(w) == o)
    return both.where(equal).select("k1", "k2").distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with their texts' remaining lines, and ``n_lines`` and ``n_kept``.

    ``docs`` needs ``doc_id`` and ``text``.  Lines end at a line feed; words are
    parted by ASCII white space, so lines that differ in white space only are
    equal.  Lines without words always stay.  Lines of fewer than
    ``NEAR_WORDS`` words go only for an equal one.

    A null text stays null and has no lines; an empty one has one empty line.
    Null ids come first.  Rows with equal id and text are one document: their
    lines stay or go alike.  Ties cannot occur between different lines, as
    places differ; texts with one id are put in order by line number, then by
    the text's hash.  Other columns stay, except ones named ``n_lines`` and
    ``n_kept``.  An empty table gives an empty result.
    """
    columns, docs = docs.columns, packed(docs, "doc_id", "text")
    lines = stage(_occurrences(docs), "lines")
    place = F.struct("doc_id", "line", "text_key")
    halves = [f"{role}{k}" for role in ("same", "longer") for k in (0, 1)]
    classes = stage(lines.groupBy("k1", "k2").agg(F.min(place).alias("place"), F.max(place).alias("last"), *[F.first(h).alias(h) for h in halves]), "lines-classes")
    near = _near(docs, classes)
    gone = classes.join(near.withColumn("near", F.lit(True)), ["k1", "k2"], "left").where(F.col("near") | (F.col("place") < F.col("last")))
    gone = stage(gone.select("k1", "k2", F.col("place").alias("earliest"), F.coalesce("near", F.lit(False)).alias("near")), "lines-gone")
    drop = lines.select("k1", "k2", place.alias("place")).join(small(gone), ["k1", "k2"]).where(F.col("near") | (F.col("place") > F.col("earliest")))
    drop = drop.groupBy(F.col("place.doc_id").alias("drop_id"), F.col("place.text_key").alias("drop_text")).agg(F.collect_set("place.line").alias("drop_lines"))
    drop = stage(drop, "lines-drop", few=True)
    out = docs.withColumn("text_key_", _text_key(docs)).join(small(drop), docs["doc_id"].eqNullSafe(F.col("drop_id")) & (F.col("text_key_") == F.col("drop_text")), "left")
    feeds = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    out = out.withColumn("n_lines", F.coalesce(feeds + 1, F.lit(0)).cast("long"))
    stay = F.array_except(F.sequence(F.lit(1), F.col("n_lines").cast("int")), F.transform("drop_lines", lambda k: k + 1))
    out = out.withColumn("n_kept", F.col("n_lines") - F.coalesce(F.when(F.col("drop_lines").isNotNull(), F.size("drop_lines")), F.lit(0)))
    text = F.when(F.col("drop_lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.element_at(F.col("all_lines"), k)), "\n"))
    out = out.withColumn("all_lines", F.when(F.col("drop_lines").isNotNull(), F.split("text", "\n", -1))).withColumn("text", text)
    return unpacked(out, columns, "n_lines", "n_kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = rf"""
with l as (
  select doc_id, i - 1 as line, regexp_extract_all(t[i], '[^\x20\x09-\x0D]+') as words
  from (select doc_id, string_split(text, chr(10)) as t from documents) d, unnest(range(1, len(t) + 1)) as r(i)),
c as (select words, len(words) as n, min(row(doc_id, line)) as place, row_number() over () as id from l where len(words) > 0 group by words),
v as (
  select id, place, 0 as kind, n, i, list_concat(words[1 : i - 1], words[i + 1 :]) as rest from c, unnest(range(1, n + 1)) as r(i) where n >= {NEAR_WORDS}
  union all select id, place, 1, n, 0, words from c where n >= {NEAR_WORDS}
  union all select id, place, 2, n - 1, 0, list_concat(words[1 : i - 1], words[i + 1 :]) from c, unnest(range(1, n + 1)) as r(i) where n - 1 >= {NEAR_WORDS}),
m as (select *, min(case when kind < 2 then place end) over g as base, min(case when kind = 2 then place end) over g as longer
  from v window g as (partition by n, i, rest)),
near as (select distinct id from m where case when kind = 1 then longer < place else base < place end),
stay as (select l.doc_id, l.line from l left join c on l.words = c.words
  where len(l.words) = 0 or (c.place = row(l.doc_id, l.line) and c.id not in (select id from near))),
k as (select s.doc_id, count(*) as n_kept, string_agg(string_split(d.text, chr(10))[s.line + 1], chr(10) order by s.line) as text
  from stay s join documents d using (doc_id) group by s.doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(k.n_kept, 0)::bigint as n_kept, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join k using (doc_id)
"""
