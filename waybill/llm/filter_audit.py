"""Audit of filters that are applied one after another: what each removes at each place of each order.

A document is known by its mask, the set of filters it fails. An order removes it at the first of its failing filters, so what an
order does follows from the number of documents per part and mask.

Orders have their lexicographic (Lehmer) ranks. All orders with one beginning stand side by side in them: a beginning of ``s`` of
``n`` filters is an interval of ``(n - s)!`` ranks. A mask is removed at step ``s`` by the orders whose first ``s - 1`` filters it
passes and whose next one it fails, so by one interval for each such beginning. Its counts are added where an interval begins and taken
off where it ends; one running sum over the ranks then gives what each step of each order removes.

1. Masks of the documents, in one scan. A copy of an earlier document (``copy_of_earlier``) is found by the digest of the text: rows
   are pre-aggregated per digest before they meet, so a text that a third of all rows share is a few rows there.
2. Counts per part and mask: at most 2^n rows a part, written once.
3. Interval ends, running sums, totals: ``n * n!`` rows a part. The intervals are a table made from n alone, n at most 7.

Defined results: a NULL text is empty; a NULL part is the empty string; a document without a key copies none and is no earlier one;
rows equal in key and text are no copies of one another; a document is good (toxic) if any of its labels says so; unknown keys
and NULLs among labels count for nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.frames import WORD, checkpointed, named

MOST_FILTERS = 7
#: Stands for the filter that removes copies of documents with a smaller key.
COPY = "copy of an earlier document"


def orders(names: list[str]) -> list[tuple[int, str, list[str]]]:
    """Rank, name and filters of every order."""
    return [(rank, "".join(order), list(order)) for rank, order in enumerate(permutations(sorted(names)))]


def lehmer_rank(beginning: tuple[int, ...], n: int) -> int:
    """The rank of the first order of ``n`` that begins so."""
    left, rank = list(range(n)), 0
    for step, filter_ in enumerate(beginning, 1):
        rank += left.index(filter_) * factorial(n - step)
        left.remove(filter_)
    return rank


def intervals(n: int) -> list[tuple[int, int, int, int]]:
    """For each mask the intervals of orders that remove it, as (mask, step, first rank, rank behind)."""
    out = []
    for mask in range(1, 1 << n):
        passed = [f for f in range(n) if not mask >> f & 1]
        failed = [f for f in range(n) if mask >> f & 1]
        for step in range(1, len(passed) + 2):
            for before in permutations(passed, step - 1):
                for filter_ in failed:
                    rank = lehmer_rank((*before, filter_), n)
                    out.append((mask, step, rank, rank + factorial(n - step)))
    return out


def text_filters(text: Column) -> dict[str, Column | str]:
    """The filters of the registered query: conditions under which a text fails."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": COPY,
    }


def _mask(filters: Mapping[str, Column | str], text: Column) -> Column:
    bits = [F.when(F.coalesce(fails, F.lit(False)), F.lit(1 << i)).otherwise(0)
            for i, (_, fails) in enumerate(sorted(filters.items())) if not isinstance(fails, str)]
    return sum(bits, F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column | str], key: str = "doc_id", text: str = "text",
                part: str = "lang") -> DataFrame:
    """Rows (part, mask, n, good, toxic) that add up to the documents of each part and mask, without those of no document.

    ``filters``: conditions over a column ``text``, or ``COPY``.
    """
    whole = docs.select(named(key).alias("key"), F.coalesce(named(part).cast("string"), F.lit("")).alias("part"),
                        F.coalesce(named(text), F.lit("")).alias("text"))
    rows = whole.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _mask(filters, F.col("text")).alias("mask"))
    # Rows without a key meet no label: dealt out by their digest.
    rows = rows.withColumn("salt", F.when(F.col("key").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint")))
    marked = (labels.where(named(key).isNotNull()).groupBy(named(key).alias("key"), F.lit(0).cast("bigint").alias("salt"))
              .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                   F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    known = rows.join(marked, ["key", "salt"], "left").withColumns({
        c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    same = ["digest", "part", "mask", "good", "toxic"]
    # One row per key and text first, so that the least key comes with the number of its rows.
    least = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("least")
    alike = (known.groupBy("key", "salt", *same).agg(F.count("*").alias("n"))
             .groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("keyless"), least))
    copy = [i for i, (_, fails) in enumerate(sorted(filters.items())) if isinstance(fails, str)]
    if copy:
        alike = alike.withColumn("first", F.min("least.key").over(Window.partitionBy("digest")))
        stay = F.col("keyless") + F.when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0)
        both = F.array(F.struct(F.col("mask"), stay.alias("n")),
                       F.struct((F.col("mask") + sum(1 << i for i in copy)).alias("mask"), (F.col("n") - stay).alias("n")))
        alike = alike.select("part", "good", "toxic", F.inline(both))
    return (alike.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")))


def _table(rows: list[tuple], *names: str) -> pa.Table:
    columns = [pa.array(c) for c in zip(*rows)]
    return pa.table([c.cast(pa.int32()) if c.type == pa.int64() else c for c in columns], names=list(names))


_WEIGHTS = ("n", "good", "toxic")


def audit(counts: DataFrame, names: list[str]) -> DataFrame:
    """For counts (part, mask, n, good, toxic): one row per part, order and step.

    Columns part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    names, n = sorted(names), len(names)
    if n > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    spark, ranks = counts.sparkSession, factorial(n)
    # From Arrow tables, so that Spark knows how small they are.
    ends = spark.createDataFrame(_table(
        [(mask, step, rank, sign) for mask, step, first, behind in intervals(n) for rank, sign in ((first, 1), (behind, -1))],
        "mask", "step", "rank", "sign"))
    places = spark.createDataFrame(_table(
        [(rank, order, step, filter_) for rank, order, filters in orders(names) for step, filter_ in enumerate(filters, 1)],
        "rank", "filter_order", "step", "filter"))
    each = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.struct(F.lit(name).alias("filter"),
                           F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0)).alias("fails"),
                           F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias("unique_fails"))
                  for i, name in enumerate(names)]).alias("filters"))
    # The difference arrays: one per part and step, over the ranks.
    differences = counts.join(ends, "mask").groupBy("part", "step", "rank").agg(
        *[F.sum(F.col(w) * F.col("sign")).alias(w) for w in _WEIGHTS])
    grid = each.select("part", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank")).select(
        "part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"), "rank")
    along = Window.partitionBy("part", "step").orderBy("rank")
    sums = (grid.join(differences, ["part", "step", "rank"], "left")
            .select("part", "step", "rank", *[F.sum(F.coalesce(w, F.lit(0))).over(along).alias(w) for w in _WEIGHTS]))
    placed = sums.join(places, ["rank", "step"]).join(
        each.select("part", "total", F.inline("filters")), ["part", "filter"])
    until, over_all = Window.partitionBy("part", "rank").orderBy("step"), Window.partitionBy("part", "filter")
    return placed.select(
        "part", "filter_order", "step", "filter", (F.col("total") - F.sum("n").over(until)).alias("kept"), F.col("n").alias("removed"),
        (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"), F.sum("n").over(over_all).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column | str] | None = None, key: str = "doc_id",
                  text: str = "text", part: str = "lang") -> DataFrame:
    """``audit`` of documents by filters over a column ``text``; those of the registered query if none are given."""
    filters = text_filters(F.col("text")) if filters is None else filters
    return audit(checkpointed(mask_counts(docs, labels, filters, key, text, part)), list(filters))
