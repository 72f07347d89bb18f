"""Near copies by ProbMinHash: signatures of weighted word shingles, banding, exact verification.

1. Exact copies are one node, by the digest of the text.
2. Every node has a signature (see ``shingles``); nodes that agree in all rows of a band share a bucket.
3. In each bucket the members are compared with its pivot, the member that shares most buckets with most
   others: the original of a group of copies is like all of them while they may be less like one another. A pair is first
   estimated by the signatures, then verified exactly on the texts.
4. Linked nodes make components. Members of a bucket that are left outside the pivot's component are compared with those in
   other components, in tiles inside the tasks. So each pair that shares a bucket has been compared or is in one component
   already: the classes are those that comparing all pairs of all buckets would give, and only links leave a task.

Similarity is the probability Jaccard of the shingles, weighted 1 + ln(count); for texts that don't repeat themselves
this is the plain Jaccard. With 32 bands of 6 a pair at 0.8 shares a bucket with probability 0.9999.

Nodes, links and components stay in tables; nothing is collected but counts.

Defined results: a document without words (or NULL) has no shingles, it is alike only to exact copies with words, so it is a
class of its own text; repeated rows are copies; the class id is the smallest key of the class, NULL where all
are NULL; an empty table gives no rows; other columns are not read, and pass as they are in ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm import shingles
from waybill.llm.arrow import replaced, texts
from waybill.llm.frames import checkpointed, named, unpacked, whole

BANDS, ROWS = 32, 6
THRESHOLD = 0.8
#: Pairs estimated below are not verified: four standard deviations of the estimate below the threshold.
LEAST_ESTIMATE = 0.68
BYTES_AT_ONCE = 4_000_000
#: Members of a tile, on average, and bytes of their texts.
TILE, TILE_BYTES = 2000, 8_000_000
SALTS = 32


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """8 bits of each register; NULL for a text without words."""
    for batch, rows in texts(batches, BYTES_AT_ONCE):
        text, element, weight = shingles.shingles(rows)
        held = shingles.signatures(text, element, weight, len(rows), BANDS * ROWS)
        some = np.bincount(text, minlength=len(rows)) > 0
        sign = (shingles.mix(held) >> np.uint64(56)).astype("u1")
        yield replaced(batch, ["node", "key"],
                       sign=pa.array([s.tobytes() if any_ else None for s, any_ in zip(sign, some)], pa.binary()))


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures to buckets: a number for each band and the registers in it."""
    for batch in batches:
        n = batch.num_rows
        if n:
            sign = np.frombuffer(b"".join(batch.column("sign").to_pylist()), "u1").reshape(n, BANDS, ROWS)
            bucket = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(ROWS):
                    bucket = shingles.mix(bucket * np.uint64(0x9E3779B97F4A7C15) + sign[:, :, k].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.view(np.int64).ravel()), batch.column("node").take(pa.array(np.repeat(np.arange(n), BANDS)))],
                names=["bucket", "node"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in enough registers."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(batch.num_rows, -1)
                    for c in ("a_sign", "b_sign"))
            alike = (a == b).mean(axis=1) >= LEAST_ESTIMATE
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(alike))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts that are alike. Each text of a slice is cut into shingles once."""
    for batch in batches:
        a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "a_text", "b_text"))
        start = 0
        while start < len(a):
            texts_of: dict[bytes, str] = {}
            stop, held = start, 0
            while stop < len(a) and (stop == start or held < BYTES_AT_ONCE and len(texts_of) < 60_000):
                for node, text in ((a[stop], x[stop]), (b[stop], y[stop])):
                    if node not in texts_of:
                        texts_of[node] = text or ""
                        held += len(texts_of[node])
                stop += 1
            text, element, weight = shingles.shingles([t.encode() for t in texts_of.values()])
            edges = np.searchsorted(text, np.arange(len(texts_of) + 1))
            place = {node: slice(i, j) for node, i, j in zip(texts_of, edges, edges[1:])}
            alike = [k for k in range(start, stop) if shingles.similarity(
                element[place[a[k]]], weight[place[a[k]]], element[place[b[k]]], weight[place[b[k]]]) >= THRESHOLD]
            yield batch.select(["a", "b"]).take(pa.array(alike, pa.int64()))
            start = stop


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _texts(nodes: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """One text for each node that shares a bucket: that of the node's key. Written along the way, as it is read twice."""
    needed = members.select(F.col("node").alias("_node")).join(
        nodes.select(F.col("node").alias("_n"), F.col("key").alias("_key")), F.col("_node") == F.col("_n"))
    return checkpointed(
        docs.join(needed, (F.col("node") == F.col("_node")) & F.col("key").eqNullSafe(F.col("_key")))
        .select("node", "text").dropDuplicates(["node"]))


def _links(pairs: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near copies; written along the way."""
    signs = nodes.select("node", "sign")
    likely = (pairs.distinct()
              .join(signs.select(F.col("node").alias("a"), F.col("sign").alias("a_sign")), "a")
              .join(signs.select(F.col("node").alias("b"), F.col("sign").alias("b_sign")), "b")
              .mapInArrow(_agree, "a binary, b binary"))
    return checkpointed(
        likely.join(found.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
        .join(found.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
        .mapInArrow(_verify, "a binary, b binary"))


def components(links: DataFrame) -> DataFrame:
    """Every linked node with the smallest node of its component, as (node, root).

    Labels go along links to the smallest neighbour and then to the label of the label, until none changes; each round
    is written, so a lost executor costs one round.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
                          .withColumnRenamed("a", "node"))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("seen")))
        stepped = (labels.join(near, F.col("node") == F.col("a"))
                   .select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root")))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        stepped = checkpointed(stepped.join(jump, "root").select(
            "node", "old", F.least("root", "further").alias("root")))
        labels = stepped.select("node", "root")
        if stepped.where("old <> root").isEmpty():
            return labels


def _members(nodes: DataFrame) -> DataFrame:
    """Nodes that share a bucket: node, total (sizes of its buckets), buckets. At most ``BANDS`` rows a node go through."""
    buckets = nodes.where("sign is not null").select("node", "sign").mapInArrow(_band, "bucket bigint, node binary")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return checkpointed(buckets.join(shared, "bucket").groupBy("node").agg(
        F.sum("size").alias("total"), F.collect_list("bucket").alias("buckets")))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (node, key, text): nodes (node, key, copies, sign), and the root of each linked node."""
    signed = docs.mapInArrow(_sign, f"node binary, key {docs.schema['key'].dataType.simpleString()}, sign binary")
    nodes = checkpointed(signed.groupBy("node").agg(F.min("key").alias("key"), F.count("*").alias("copies"),
                                                    F.first("sign").alias("sign")))
    members = _members(nodes)
    found = _texts(nodes, members, docs)
    rows = members.select("node", "total", F.explode("buckets").alias("bucket"))
    pivots = rows.groupBy("bucket").agg(F.max(F.struct("total", "node"))["node"].alias("pivot"))
    placed = checkpointed(rows.join(pivots, "bucket").select("bucket", "node", "pivot"))
    links = _links(placed.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")), nodes, found)
    roots = components(links)

    root_of = checkpointed(roots.select(F.col("node").alias("_n"), F.col("root").alias("_r")))
    groups = (placed.select("node", "pivot").distinct()
              .join(root_of, F.col("node") == F.col("_n"), "left")
              .select("node", "pivot", F.coalesce("_r", "node").alias("root"))
              .join(root_of, F.col("pivot") == F.col("_n"), "left")
              .select(F.coalesce("_r", "pivot").alias("group"), "node", "root").distinct())
    more = _rest(groups, nodes, found)
    if not more.isEmpty():
        roots = components(links.union(more))
    return nodes, roots


def _rest(groups: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Links between components that the pivots didn't show.

    A group (``group``, ``node``, ``root``) has the members of all buckets whose pivot is in one component, so all pairs that
    share a bucket are in some group. Members outside the pivot's component are compared with all members in other components,
    in tiles: first by signatures, then, for members that are estimated to be near any, by their texts.
    """
    outside = F.col("root") != F.col("group")
    groups = checkpointed(groups.join(groups.where(outside).select("group").distinct(), "group", "left_semi"))
    signed = groups.join(nodes.select(F.col("node").alias("_n"), "sign"), F.col("node") == F.col("_n")).drop("_n")
    near = _tiles(signed, ["node", "root", "sign"], F.lit(0)).mapInArrow(_near, "group binary, node binary").distinct()
    near = checkpointed(signed.join(near, ["group", "node"]))
    texts_of = found.select(F.col("node").alias("_n"), "text")
    written = near.join(texts_of, F.col("node") == F.col("_n")).drop("_n")
    return checkpointed(_tiles(written, ["node", "root", "sign", "text"], F.length("text")).mapInArrow(_compare, "a binary, b binary"))


def _tiles(members: DataFrame, columns: list[str], size: Column) -> DataFrame:
    """Pairs of tiles of each group: ``left`` has members outside the group's component, ``right`` any."""
    sizes = members.groupBy("group").agg(F.ceil(F.greatest(
        F.count("*") / TILE, F.sum(F.coalesce(size, F.lit(0))) / TILE_BYTES)).cast("int").alias("tiles"))
    # A group may hold a third of all members: deal it over salts.
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tiled = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["group", "salt"])
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    packed = F.collect_list(F.struct(*columns))
    right = tiled.groupBy("group", "tile").agg(packed.alias("right"))
    left = (tiled.where("root <> group").groupBy("group", "tiles", F.col("tile").alias("left_tile"))
            .agg(packed.alias("left"))
            .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A pair of tiles is much work and few bytes: keep the tasks apart.
    return (left.join(right, ["group", "tile"]).repartition(parts, "group", "tile", "left_tile")
            .select("group", "left", "right"))


def _candidates(batches: Iterator[pa.RecordBatch]):
    """For each pair of tiles: the group, the members, and the places of pairs that may be near copies."""
    for batch in batches:
        for i in range(batch.num_rows):
            left, right = (batch.column(c)[i].as_py() for c in ("left", "right"))
            group = batch.column("group")[i].as_py()
            signs = [np.stack([np.frombuffer(m["sign"], "u1") for m in side]) for side in (left, right)]
            for k, member in enumerate(left):
                alike = (signs[1] == signs[0][k]).mean(axis=1) >= LEAST_ESTIMATE
                # A pair of two outside members comes up twice.
                at = [j for j in np.flatnonzero(alike) if right[j]["root"] != member["root"]
                      and (right[j]["root"] == group or member["node"] < right[j]["node"])]
                if at:
                    yield group, member, [right[j] for j in at]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that are estimated to be near another."""
    seen: set[tuple[bytes, bytes]] = set()
    for group, member, others in _candidates(batches):
        seen.update((group, m["node"]) for m in (member, *others))
        if len(seen) > 20_000:
            yield _pairs(list(seen), "group", "node")
            seen.clear()
    yield _pairs(list(seen), "group", "node")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of members to other components, one for each pair of components that a task sees."""
    held: dict[bytes, tuple] = {}
    joined: set[tuple[bytes, bytes]] = set()
    links = []

    def cut(member):
        if member["node"] not in held:
            if len(held) > 2 * TILE:
                held.clear()
            held[member["node"]] = shingles.shingles([(member["text"] or "").encode()])[1:]
        return held[member["node"]]

    for _, member, others in _candidates(batches):
        own = cut(member)
        for other in others:
            pair = (member["root"], other["root"])
            if pair not in joined and shingles.similarity(*own, *cut(other)) >= THRESHOLD:
                if len(joined) < 100_000:  # only saves repeated links
                    joined.add(pair)
                links.append((member["node"], other["node"]))
        if len(links) > 20_000:
            yield _pairs(links, "a", "b")
            links = []
    yield _pairs(links, "a", "b")


def _pairs(rows: list[tuple[bytes, bytes]], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=list(names))


def _chosen(nodes: DataFrame, roots: DataFrame, key: str = "key") -> DataFrame:
    """Each node with its class: node, class_key, chosen (the node whose text stays), size."""
    placed = nodes.select("node", "key", "copies").join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    placed = placed.select("node", "key", "copies", F.coalesce("root", "node").alias("root"))
    first = F.struct(F.col("key").isNull(), F.col("key"), F.col("node"))
    best = placed.groupBy("root").agg(F.min(first).alias("_first"), F.sum("copies").alias("class_size"))
    return placed.join(best.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select(
        "node", F.col("_first.key").alias("class_key"), F.col("_first.node").alias("chosen"), "class_size")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id (smallest key of its class), class_size, kept (it stands for its class)."""
    rows = docs.select(_digest(named(text)).alias("node"), named(key).alias("key"), named(text).alias("text"))
    nodes, roots = _classes(rows)
    chosen = _chosen(nodes, roots).withColumnRenamed("node", "_node")
    return (rows.select("node", "key").join(chosen, F.col("node") == F.col("_node"))
            .select(F.col("key").alias(key), F.col("class_key").alias("class_id"), "class_size",
                    ((F.col("node") == F.col("chosen")) & F.col("key").eqNullSafe(F.col("class_key"))).alias("kept")))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all columns of ``docs``: the one with the smallest key, whole."""
    columns = docs.columns
    whole_rows = docs.select(whole(columns), _digest(named(text)).alias("node"), named(key).alias("key"))
    rows = docs.select(_digest(named(text)).alias("node"), named(key).alias("key"), named(text).alias("text"))
    nodes, roots = _classes(rows)
    stays = (_chosen(nodes, roots).where(F.col("node") == F.col("chosen"))
             .select(F.col("node").alias("_node"), F.col("class_key").alias("_key")))
    # Rows equal in key and text: how often, so that only those are looked at again.
    often = rows.groupBy("node", "key").agg(F.count("*").alias("_rows"))
    stays = stays.join(often.withColumnsRenamed({"node": "_n", "key": "_k"}),
                       (F.col("_node") == F.col("_n")) & F.col("_key").eqNullSafe(F.col("_k"))).drop("_n", "_k")
    kept = whole_rows.join(stays, (F.col("node") == F.col("_node")) & F.col("key").eqNullSafe(F.col("_key")))
    single = kept.where("_rows = 1").select("row")
    return single.unionByName(kept.where("_rows > 1").dropDuplicates(["_node"]).select("row")).select(*unpacked(columns))
