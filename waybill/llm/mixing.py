"""Mix sources to target weights by pivotal dependent rounding.

A document of a source whose target is ``r`` times its size is to be taken ``r`` times. The whole part
is certain; the fraction is rounded by the pivotal method: two documents exchange words until one of
them is taken or left, the direction being drawn so that every document keeps its expectation and the
words of the pair keep their sum. What is left of a group of documents is one residual, and residuals
meet again in the groups of the next level. The one residual of a source goes to the nearer side, so a source
ends within half a document of its target.

Groups are small (``GROUP`` units on average, by hash), whatever a source holds, and the levels are a
reduction tree: each has a ``GROUP``-th of the rows of the one before. All draws are hashes, so reruns
agree. DataFrame functions only.

Defined results: a NULL text has no words; a document without words is never taken but returned; NULL is a
source of its own, the last; repeated rows are units of their own; an empty table gives no rows; columns
other than the four named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.frames import checkpointed, named, uniform, unpacked, whole, word_count

#: Units that meet in one group of the tree, on average.
GROUP = 96
#: Parts into which each source is dealt where units meet the table of sources.
SALTS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``).

    Sources by code point, NULL last, weigh ``weights`` in turn. Sources that reach ``most`` times their size
    stop there, and what they leave is shared by weight among the rest. A source stops when its bound per
    weight is below the level of those that go on, so the sources that stop are a prefix in that order.
    The window sees one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("_weight", weight).withColumn("_bound", F.col("source_size") * most)
    order = (F.col("_bound") / F.col("_weight"), F.col("source").asc_nulls_first())
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("_bound").over(before), F.lit(0)))
             / F.sum("_weight").over(after))
    ranked = ranked.withColumn("_level", level)
    goes_on = F.col("_level") * F.col("_weight") <= F.col("_bound")
    ranked = ranked.withColumn("_level", F.max(F.when(goes_on, F.col("_level"))).over(whole))
    target = F.least(F.col("_bound").cast("double"), F.col("_level") * F.col("_weight"))
    return ranked.select("source", F.col("source_size").cast("bigint").alias("source_size"),
                         F.coalesce(target, F.lit(0.0)).alias("target"))


def _pivot(state: Column, unit: Column, seed: int) -> Column:
    """One exchange between the open unit and the next; ``words`` are those a unit is to be taken for."""
    held = state["open"]
    room, next_room = held["size"] - held["words"], unit["size"] - unit["words"]
    up, down = F.least(room, unit["words"]), F.least(held["words"], next_room)
    rise = uniform(held["draw"], unit["draw"], F.lit(seed)) * (up + down) < down

    def but(struct, words):
        return struct.withField("words", words)

    def taken(struct, yes):
        return struct.withField("words", F.when(F.lit(yes), struct["size"].cast("double")).otherwise(F.lit(0.0)))

    # Either the held unit is settled and the next one stays open, or the reverse.
    settles = F.when(rise, room <= unit["words"]).otherwise(held["words"] <= next_room)
    open_unit = (F.when(rise & settles, but(unit, unit["words"] - room))
                 .when(rise, but(held, held["words"] + unit["words"]))
                 .when(settles, but(unit, unit["words"] + held["words"]))
                 .otherwise(but(held, held["words"] - next_room)))
    settled = (F.when(rise & settles, taken(held, True)).when(rise, taken(unit, False))
               .when(settles, taken(held, False)).otherwise(taken(unit, True)))
    first = held.isNull()
    return F.struct(F.when(first, unit).otherwise(open_unit).alias("open"),
                    F.when(first, state["settled"])
                    .otherwise(F.concat(state["settled"], F.array(settled))).alias("settled"))


def _level(units: DataFrame, kind: str, level: int, seed: int) -> DataFrame:
    """Units of a level to one row per group: the residual, and the units settled."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("_units") / float(GROUP ** (level + 1))))
    part = F.pmod(F.xxhash64("_unit.draw", F.lit(seed), F.lit(level)), parts)
    carried = ["source", "source_size", "target", "_whole", "_units"]
    grouped = (units.groupBy("source", part.alias("_part"))
               .agg(*[F.first(c).alias(c) for c in carried[1:]],
                    F.array_sort(F.collect_list("_unit")).alias("_list")))
    start = F.struct(F.lit(None).cast(kind).alias("open"),
                     F.array().cast(f"array<{kind}>").alias("settled"))
    out = F.aggregate("_list", start, lambda state, unit: _pivot(state, unit, seed + level))
    return grouped.select(*carried, out.alias("_out"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7,
                identity: tuple[str, ...] = ("doc_id",), text: str = "text",
                source: str = "source") -> DataFrame:
    """One row per document: ``identity`` columns, source, size, source_size, target, copies, taken.

    ``copies`` is how often the document goes into the mix, at most ``most``; ``taken`` the words this
    makes. Rows equal in ``identity``, source and size are told apart by a running number.
    """
    ids = [named(c).alias(f"_id{i}") for i, c in enumerate(identity)]
    names = [f"_id{i}" for i in range(len(identity))]
    sized = docs.select(*ids, named(source).cast("string").alias("source"),
                        word_count(named(text)).alias("size"))
    # One narrow row per distinct unit: the only pass over the texts.
    units = checkpointed(sized.groupBy(*names, "source", "size").agg(F.count("*").alias("_times")))
    sizes = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("_times")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("_times")).otherwise(0)).alias("_units"))
    targets = (source_targets(sizes.select("source", "source_size"), weights, most)
               .withColumnRenamed("source", "_s"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = checkpointed(
        targets.join(sizes.select("source", "_units"), F.col("_s").eqNullSafe(F.col("source")))
        .select("_s", "source_size", "target", "_units",
                F.floor(ratio).alias("_whole"), (ratio - F.floor(ratio)).alias("_part")))
    largest = plan.agg(F.max("_units")).first()[0] or 0

    # A source may hold a third of all rows: deal it over salts, and its one row of the plan with it.
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*names, "size"), F.lit(SALTS)).cast("int")
    units = (units.withColumn("_salt", salt).alias("u")
             .join(salted.alias("p"), (F.col("u._salt") == F.col("p._salt"))
                   & F.col("u.source").eqNullSafe(F.col("p._s")))
             .drop("_salt", "_s"))
    units = units.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))

    def result(rows: DataFrame, extra: Column) -> DataFrame:
        copies, size = (F.col("_whole") + extra).cast("bigint"), F.col("size").cast("bigint")
        return rows.select(*[F.col(n).alias(c) for n, c in zip(names, identity)], "source",
                           size.alias("size"), "source_size", "target",
                           F.when(size > 0, copies).otherwise(0).alias("copies"),
                           (copies * size).alias("taken"))

    fractional = (F.col("_part") > 0) & (F.col("size") > 0)
    out = result(units.where(~fractional), F.lit(0))
    # Large documents first: the residual is then seldom a large one.
    unit = F.struct((-F.col("size")).alias("order"),
                    F.xxhash64(*names, "size", "_copy", F.lit(seed)).alias("draw"),
                    *[F.col(n) for n in names], F.col("_copy").alias("copy"),
                    F.col("size").cast("double").alias("size"),
                    (F.col("_part") * F.col("size")).alias("words"))
    open_units = units.where(fractional).select("source", "source_size", "target", "_whole",
                                                "_units", unit.alias("_unit"))
    kind = open_units.schema["_unit"].dataType.simpleString()
    level = 0
    while True:
        tree = checkpointed(_level(open_units, kind, level, seed))
        settled = tree.withColumn("_unit", F.explode("_out.settled"))
        out = out.unionByName(result(settled.select("*", "_unit.*"),
                                     (F.col("words") > 0).cast("int")))
        open_units = tree.select("source", "source_size", "target", "_whole", "_units",
                                 F.col("_out.open").alias("_unit"))
        if largest <= GROUP ** (level + 1):
            break
        level += 1
    last = F.col("words") * 2 >= F.col("size")
    return out.unionByName(result(open_units.select("*", "_unit.*"), last.cast("int")))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: every document as often as its copies, with all columns of ``docs``.

    Rows are told apart by two hashes of all their columns; rows equal in all are one unit with as many copies
    as the rows have together.
    """
    columns = docs.columns
    rows = docs.select(whole(columns), named(text).alias("text"), named(source).alias("source"))
    keyed = rows.withColumns({"_h0": F.xxhash64("row"), "_h1": F.xxhash64(F.lit(1), "row")})
    mixed = (mix_sources(keyed, identity=("_h0", "_h1"), **how)
             .where("copies > 0").groupBy("_h0", "_h1").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
             .withColumnsRenamed({"_h0": "_m0", "_h1": "_m1"}))
    taken = keyed.drop("text", "source").join(mixed, (F.col("_h0") == F.col("_m0")) & (F.col("_h1") == F.col("_m1")))
    # Equal rows were counted together, also those that were not taken.
    often = keyed.groupBy("_h0", "_h1").count().where("count > 1")
    repeated = taken.join(often.select("_h0", "_h1"), ["_h0", "_h1"], "left_semi").dropDuplicates(["_h0", "_h1"])
    single = taken.join(often.select("_h0", "_h1"), ["_h0", "_h1"], "left_anti")
    return (single.select("row", "_copies").unionByName(repeated.select("row", "_copies"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
            .select(*unpacked(columns)))
