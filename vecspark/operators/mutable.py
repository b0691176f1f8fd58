"""Changes to a table of vectors: upsert, soft and hard deletes, replacement, lookup, capacity.

Every function returns the new table; nothing is changed in place, so searches
of an older version go on undisturbed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, more: DataFrame) -> DataFrame:
    """``base`` with the rows of ``more``, which take the place of rows with equal ids; of equal ids in ``more``, the one of the greatest vector by order stays."""
    one = more.withColumn("_n", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("embedding")))).where("_n = 1").drop("_n")
    return base.join(one.select("vec_id"), "vec_id", "left_anti").unionByName(one)


def marked(tombstones: DataFrame, ids: DataFrame, base: DataFrame) -> DataFrame:
    """Tombstones with more ids; an id that is unknown or marked already is an error."""
    if ids.join(base, "vec_id", "left_anti").limit(1).count() or ids.join(tombstones, "vec_id", "left_semi").limit(1).count():
        raise ValueError("an id is unknown or deleted already")
    return tombstones.unionByName(ids.select("vec_id"))


def unmarked(tombstones: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstones without some ids; an id that is not marked is an error."""
    if ids.join(tombstones, "vec_id", "left_anti").limit(1).count():
        raise ValueError("an id is not deleted")
    return tombstones.join(ids, "vec_id", "left_anti")


def alive(base: DataFrame, tombstones: DataFrame) -> DataFrame:
    return base.join(tombstones, "vec_id", "left_anti")


def removed(base: DataFrame, ids: DataFrame) -> DataFrame:
    """``base`` without some ids; unknown ones don't matter."""
    return base.join(ids, "vec_id", "left_anti")


def replaced(base: DataFrame, tombstones: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``base`` and its tombstones after new rows took the places of deleted ones.

    Each new row takes one deleted place, in order of id; the old id is gone for
    good.  New rows beyond the deleted ones are added.
    """
    n = more.select("vec_id").distinct().count()
    gone = tombstones.orderBy("vec_id").limit(n)
    return upsert(base.join(gone, "vec_id", "left_anti"), more), tombstones.join(gone, "vec_id", "left_anti").join(more, "vec_id", "left_anti")


def vectors(base: DataFrame, ids: list[int] | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """The rows of some ids (all, if not given); an id that is unknown or deleted is an error."""
    rows = alive(base, tombstones) if tombstones is not None else base
    if ids is None:
        return rows
    wanted = base.sparkSession.createDataFrame([(int(x),) for x in sorted(set(ids))], "vec_id long")
    found = rows.join(F.broadcast(wanted), "vec_id")
    if found.count() < len(set(ids)):
        raise KeyError("an id is unknown or deleted")
    return found


def check_capacity(base: DataFrame, more: int, most: int) -> None:
    """Raise if ``more`` rows don't fit under ``most``."""
    if base.count() + more > most:
        raise ValueError(f"more than {most} vectors")


def counts(base: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``total, deleted``: all rows, and how many of them are marked."""
    marks = base.select("vec_id").join(tombstones.distinct().withColumn("mark", F.lit(1)), "vec_id", "left")
    return marks.agg(F.count("*").alias("total"), F.count("mark").alias("deleted"))
