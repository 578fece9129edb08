"""A catalogue of profiles: unnesting, first-wins union, text search and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in ``order``. An aggregation, so keys that repeat a
    lot combine before they shuffle."""
    rest = [c for c in df.columns if c not in key]
    pick = F.min(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*rest).alias("row")))
    return df.groupBy(*key).agg(pick.alias("b")).select(*key, *(F.col(f"b.row.{c}").alias(c) for c in rest))


def unnest(df: DataFrame, settings: str, overrides: list[str]) -> DataFrame:
    """The base rows, and one row for each element of ``settings`` with its fields in place."""
    base = df.withColumn("variant", F.lit(0)).drop(settings)
    parts = df.select("*", F.posexplode(settings).alias("pos", "o"))
    put = {c: F.coalesce(F.col(f"o.{c}"), F.col(c)) for c in overrides}
    derived = parts.withColumns(put | {"variant": F.col("pos") + 1}).drop("pos", "o", settings)
    return base.unionByName(derived)


def matches(words: Column, fields: list[Column]) -> Column:
    """Whether each word lies in one of the fields (lower-cased)."""
    lower = [F.lower(f) for f in fields]

    def found(w: Column) -> Column:
        out = F.lit(False)
        for f in lower:
            out = out | f.contains(w)
        return out

    return F.forall(words, found)


def best(df: DataFrame, by: list[str], keys: list[Column], keep: list[str], **also: Column) -> DataFrame:
    """The row with the least keys in each group, and the aggregates ``also`` of the whole group."""
    pick = F.min(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.struct(*keep).alias("row")))
    return df.groupBy(*by).agg(pick.alias("b"), *(c.alias(n) for n, c in also.items())).select(*by, *(F.col(f"b.row.{c}").alias(c) for c in keep), *also)


def lookup(wanted: DataFrame, known: DataFrame, key: str, first: Column) -> DataFrame:
    """``wanted`` with the columns of ``known`` (one row a key) for the key ``first``, else for its own key; nulls if
    neither is known. Two equi-joins."""
    rest = [c for c in known.columns if c != key]
    by_first = known.select(F.col(key).alias("_first"), F.struct(*rest).alias("_a"))
    by_own = known.select(key, F.struct(*rest).alias("_b"))
    found = wanted.withColumn("_first", first).join(by_first, "_first", "left").join(by_own, key, "left")
    return found.withColumn("_hit", F.coalesce("_a", "_b")).select(*wanted.columns, *(F.col(f"_hit.{c}").alias(c) for c in rest))
