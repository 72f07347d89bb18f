"""Near copies by SimHash, with tables of distances to pivots.

1. Every text has a 64-bit fingerprint: bit i is set where it is in more than half of the hashes of its word shingles, repeats
   counted. Equal fingerprints are one node from here on.
2. Nodes within ``MOST`` differing bits are linked. The 64 bits are dealt into blocks, ``MOST`` more than are kept: two such nodes
   agree in all bits of some set of kept blocks, whichever bits differ. So nodes meet in buckets, one for each set, by their bits there;
   ``KEPT`` of them keep a bucket of unlike nodes small. It changes the work, not the links.
3. In a bucket the nodes stand in the order of their distance to the first of ``PIVOTS`` reference fingerprints. A node meets the ones
   behind it until that distance has grown by more than ``MOST``; of these pairs all are discarded whose distances to any other
   pivot differ by more, as by the triangle inequality they can't be that near; for the rest the bits are counted. Only links
   between nodes that the task has not yet connected leave it, so a group of m near copies gives m - 1 links and not m^2.
4. A bucket of more than ``TILE`` nodes (near copies in great number, as unlike nodes don't gather) is cut along its order into
   tiles of equal stretches of that distance and then by hash; only tiles whose stretches are near enough meet, each two in a group
   of their own.
5. Linked nodes make components; the id is the smallest key of their documents.

Defined results: a NULL or empty text, or one of white space, has the fingerprint 0 and is linked as any other; fewer words than a
shingle are one shingle; a text of any length is read whole; repeated rows are rows of one node; NULL keys are never the smallest, and
the id is NULL where all keys are; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.arrow import replaced, texts
from waybill.llm.frames import checkpointed, named
from waybill.llm.near_copies import components

WORDS, SEED = 4, 42
MOST = 4
BITS = 64
PIVOTS = 16
#: Blocks kept of ``MOST`` more: 1 to 4 make 5, 15, 35 or 70 buckets a node by 13, 21, 27 or 32 bits. 2 suits up to some 10^9 nodes.
KEPT = 2
TILE = 5_000
#: Nodes of a group up to which groups are compared side by side.
SMALL = 200
BYTES_AT_ONCE = 2_000_000
#: Shingles whose bits are counted at once.
SHINGLES_AT_ONCE = 200_000


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of the word shingles of a text in lower case, repeats included."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and the ASCII white space
    if not words:
        return []
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return [hashed(joined, SEED)]
    stop = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.append(0, stop[:-WORDS] + 1)
    return [hashed(joined[i:j], SEED) for i, j in zip(start.tolist(), stop[WORDS - 1:].tolist())]


def fingerprints(rows: list[bytes]) -> np.ndarray:
    """One number per text."""
    counts, length = np.zeros((len(rows), BITS), np.int64), np.zeros(len(rows), np.int64)
    hashes: list[int] = []
    owner: list[int] = []

    def count():
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = np.array(owner)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        counts[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        hashes.clear()
        owner.clear()

    for i, row in enumerate(rows):
        found = shingle_hashes(row)
        length[i] = len(found)
        for at in range(0, len(found), SHINGLES_AT_ONCE):
            part = found[at:at + SHINGLES_AT_ONCE]
            hashes.extend(part)
            owner.extend([i] * len(part))
            if len(hashes) >= SHINGLES_AT_ONCE:
                count()
    if hashes:
        count()
    return np.packbits(2 * counts > length[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows in texts(batches, BYTES_AT_ONCE):
        yield replaced(batch, ["key"], node=pa.array(fingerprints(rows).view("<i8"), pa.int64()))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: hashes of 1, 2, ..."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def distances(nodes: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The table: differing bits to each reference (row) of each node."""
    return np.bitwise_count(nodes ^ references[:, None]).astype(np.int8)


def _in_small_groups(group: np.ndarray, nodes: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """Links between places: every node with the one behind it, then with the next one, and so on."""
    root = list(range(len(nodes)))
    links = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    active, offset = np.arange(len(nodes)), 0
    while len(active):
        offset += 1
        active = active[:np.searchsorted(active, len(nodes) - offset)]
        # In order of the first distance: beyond MOST, all further ones are as well.
        behind = active + offset
        active = active[(group[active] == group[behind]) & (table[0][behind] - table[0][active] <= MOST)]
        pair = active
        for distance in table[1:]:
            if not len(pair):
                break
            pair = pair[np.abs(distance[pair + offset] - distance[pair]) <= MOST]
        pair = pair[np.bitwise_count(nodes[pair] ^ nodes[pair + offset]) <= MOST]
        for i in pair.tolist():
            a, b = top(i), top(i + offset)
            if a != b:
                root[b] = a
                links.append((i, i + offset))
    return links


def _in_large_group(nodes: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """Links between places of one group: every node with the stretch of the order that is near enough."""
    label = np.arange(len(nodes))
    until = np.searchsorted(table[0], table[0] + MOST, side="right")
    others = (table[1:] + MOST).astype(np.uint8)
    links = []
    for i in range(len(nodes) - 1):
        at = slice(i + 1, until[i])
        maybe = label[at] != label[i]
        for distance in others:
            maybe &= distance[at] - (distance[i] - MOST) <= 2 * MOST  # unsigned: below -MOST is large
        near = np.flatnonzero(maybe) + i + 1
        if len(near):
            near = near[np.bitwise_count(nodes[near] ^ nodes[i]) <= MOST]
            labels, first = np.unique(label[near], return_index=True)
            links.extend((i, j) for j in near[first].tolist())
            if len(labels):
                label[np.isin(label, labels)] = label[i]
    return links


def near_pairs(group: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes of one group, enough to connect all that are connected. Nodes lie group by group, by their distance to
    the first pivot."""
    table = distances(nodes, pivots())
    begin = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)]), len(group))
    size = np.diff(begin)
    small = np.repeat(size <= SMALL, size)
    places = np.flatnonzero(small)
    links = [np.array(_in_small_groups(group[small], nodes[small], table[:, small]), np.int64).reshape(-1, 2)]
    links[0] = places[links[0]]
    for k in np.flatnonzero(size > SMALL):
        at = slice(begin[k], begin[k + 1])
        links.append(np.array(_in_large_group(nodes[at], np.ascontiguousarray(table[:, at])), np.int64).reshape(-1, 2) + begin[k])
    a, b = np.concatenate(links).T
    return nodes[a], nodes[b]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node) in order of bucket and first distance, to links. A bucket may go on in the next batch."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def out(parts):
        number = np.concatenate([p[0] for p in parts])
        a, b = near_pairs(number, np.concatenate([p[1] for p in parts]))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, node = (batch.column(c).to_numpy() for c in ("bucket", "node"))
        node = node.view(np.uint64)
        last = int(np.searchsorted(bucket, bucket[-1]))  # where the last bucket begins
        if last:
            yield out([*kept, (bucket[:last], node[:last])])
            kept = []
        elif kept and kept[-1][0][-1] != bucket[0]:
            yield out(kept)
            kept = []
        kept.append((bucket[last:], node[last:]))
    if kept:
        yield out(kept)


def masks(kept: int) -> list[int]:
    """The bits of each set of ``kept`` blocks out of ``kept + MOST``, as signed numbers."""
    edges = [BITS * k // (kept + MOST) for k in range(kept + MOST + 1)]
    blocks = [(1 << j) - (1 << i) for i, j in zip(edges, edges[1:])]
    unsigned = [sum(chosen) for chosen in combinations(blocks, kept)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in unsigned]


def _bits(fingerprint: Column) -> Column:
    """Distance to the first pivot."""
    return F.bit_count(fingerprint.bitwiseXOR(F.lit(int(pivots().view(np.int64)[0])))).cast("int")


def _buckets(nodes: DataFrame, kept: int, tile: int) -> DataFrame:
    """Rows (place, bucket, node): ``bucket`` names the nodes to be compared. Its name is a hash, so different sets may
    share one; they are compared in vain then."""
    sets = F.array(*[F.struct(F.lit(i).alias("set"), F.col("node").bitwiseAND(F.lit(m)).alias("value"))
                     for i, m in enumerate(masks(kept))])
    rows = nodes.select("node", F.inline(sets)).select(
        "node", F.xxhash64("set", "value").alias("bucket"), _bits(F.col("node")).alias("far"))
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("bucket")
    # Tiles of a large bucket: each distance by itself, cut by hash where it has more nodes than a tile takes.
    tiles = rows.join(large, "bucket", "left_semi").groupBy("bucket", "far").agg(
        F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    others = tiles.select("bucket", F.col("far").alias("other"), F.col("parts").alias("other_parts"))
    near = tiles.join(others, "bucket").where(F.abs(F.col("far") - F.col("other")) <= MOST).select(
        "bucket", "far", "parts", "other", "other_parts")
    meets = near.groupBy("bucket", "far", "parts").agg(F.collect_list(F.struct("other", "other_parts")).alias("others"))
    placed = rows.join(meets, ["bucket", "far"], "left")
    own = F.struct(F.col("far"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("part"))
    # A tile meets each near one in a group that both name alike: the smaller of the two first.
    each = F.flatten(F.transform("others", lambda o: F.transform(
        F.sequence(F.lit(0), o["other_parts"] - 1),
        lambda k: F.struct(F.least(own, F.struct(o["other"].alias("far"), k.alias("part"))).alias("low"),
                           F.greatest(own, F.struct(o["other"].alias("far"), k.alias("part"))).alias("high")))))
    whole = F.array(F.lit(None).cast("struct<low:struct<far:int,part:int>,high:struct<far:int,part:int>>"))
    dealt = placed.withColumn("pair", F.explode(F.when(F.col("others").isNull(), whole).otherwise(each)))
    return dealt.select(F.when(F.col("pair").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "pair")).alias("bucket"), "far", "node")


def links(nodes: DataFrame, kept: int = KEPT, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all ``nodes`` (column node) within ``MOST`` bits."""
    rows = _buckets(nodes, kept, tile)
    return (rows.repartition("bucket").sortWithinPartitions("bucket", "far").select("bucket", "node")
            .mapInArrow(_link, "a bigint, b bigint"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: int = KEPT, tile: int = TILE) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (smallest key of the component).

    ``kept`` and ``tile`` set how the work is dealt out; the result is the same for all.
    """
    rows = docs.select(named(key).alias("key"), named(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    prints = checkpointed(rows.mapInArrow(_print, f"key {kind}, node bigint"))
    nodes = checkpointed(prints.groupBy("node").agg(F.min("key").alias("least")))
    roots = components(checkpointed(links(nodes.select("node"), kept, tile).distinct()))
    # Nodes without a link are components by themselves.
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.select("node", "root").join(least, "root").select(F.col("node").alias("_node"), "component_id")
    return prints.join(found, F.col("node") == F.col("_node")).select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
