"""Exact top-k search by inner product: tiles of queries times tiles of vectors.

Vectors are quantised (``floor(scale * x)``) and packed into tiles of rows; every tile of queries meets every
tile of vectors in one matrix product; each query keeps its best ``k`` of the tile; the short lists are merged along a
tree (first per query and branch, then per query). Nothing is approximate and no list is longer than
``k`` per tile.

The products run in float64 where all sums are below 2^53 and so exact, else in Python integers.

Defined results: a vector that is NULL or holds a NULL or non-finite component takes no part; vectors of another length
than the query's are no candidates; a component beyond 2^63 saturates, and so does a score; ties go to the smaller id, a
NULL id last; rows that share the query's id are its own and no candidates; a repeated query row gets a list of its
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.frames import checkpointed

#: Rows of a tile.
TILE = 4096
QUERY_TILE = 1024
_PACKED = "tile bigint, width int, ids binary, nulls binary, matrix binary"
_LISTS = "query_tile bigint, query_row int, branch bigint, query_id bigint, best array<struct<low:bigint,late:boolean,vec_id:bigint>>"
_LARGEST = 2 ** 63 - 1


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Rows that take part, as (id, v)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("bigint").alias("id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _pack(rows: int):
    """Batches of (id, v) to tiles of one width, numbered by partition and place in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        numbers = count(TaskContext.get().partitionId() << 33)

        def tile(width):
            ids, values = zip(*held.pop(width))
            nulls = np.concatenate([n for _, n in ids])
            return [next(numbers), width, np.concatenate([i for i, _ in ids]).tobytes(), nulls.tobytes(),
                    np.concatenate(values).astype("<i8").tobytes()]

        def out(tiles):
            columns = list(zip(*tiles))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[2:]]],
                names=["tile", "width", "ids", "nulls", "matrix"])

        for batch in batches:
            v, ids = batch.column("v"), batch.column("id")
            width = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(width) - width
            null = ids.is_null().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                matrix = flat[(starts[at][:, None] + np.arange(w)).ravel()].reshape(len(at), int(w))
                for i in range(0, len(at), rows):
                    part = slice(i, i + rows)
                    held.setdefault(int(w), []).append(
                        ((number[at[part]].astype("<i8"), null[at[part]]), matrix[part]))
                    if sum(len(m) for _, m in held[int(w)]) >= rows:
                        yield out([tile(int(w))])
        for w in list(held):
            yield out([tile(w)])
    return run


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    width = q.shape[1]
    top = max((float(np.abs(m.astype("f8")).max()) for m in (q, c) if m.size), default=0.0)
    if top * top * max(width, 1) < 2 ** 53:
        return (q.astype("f8") @ c.astype("f8").T).astype("i8")
    exact = q.astype(object) @ c.astype(object).T if width else np.zeros((len(q), len(c)), object)
    return np.clip(exact, -_LARGEST, _LARGEST).astype("i8")


def _best(k: int):
    """Pairs of tiles to the best ``k`` of the tile, per query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                qid, cid = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                null = np.frombuffer(row["nulls"], "?")
                q = np.frombuffer(row["q_matrix"], "<i8").reshape(len(qid), width)
                order = np.lexsort((cid, null))  # smaller ids first, so that a stable sort breaks ties
                c, cid, null = np.frombuffer(row["matrix"], "<i8").reshape(len(null), width)[order], cid[order], null[order]
                low = -_products(q, c)
                own = (qid[:, None] == cid[None, :]) & ~null[None, :]
                few = min(k, low.shape[1])
                low[own] = _LARGEST + 0  # behind all others
                if low.shape[1] > 4 * k:
                    edge = np.partition(low, few - 1, axis=1)[:, few - 1:few]
                else:
                    edge = np.full((len(q), 1), _LARGEST)
                best = []
                for r in range(len(q)):
                    at = np.flatnonzero(low[r] <= edge[r])
                    at = at[np.argsort(low[r, at], kind="stable")]
                    at = at[~own[r, at]][:k]
                    best.append([{"low": int(low[r, i]), "late": bool(null[i]),
                                  "vec_id": None if null[i] else int(cid[i])} for i in at])
                n = len(q)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["query_tile"]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array([row["branch"]] * n, pa.int64()), pa.array(qid, pa.int64()),
                     pa.array(best, pa.list_(pa.struct([("low", pa.int64()), ("late", pa.bool_()),
                                                        ("vec_id", pa.int64())])))],
                    names=["query_tile", "query_row", "branch", "query_id", "best"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """The ``k`` best rows for each row of ``vectors`` where ``is_query`` (an expression over ``id``).

    Columns query_id, rank (from 1), vec_id, score.
    """
    rows = quantised(vectors, key, vector, scale)
    queries = rows.where(is_query & F.col("id").isNotNull())
    total, asked = rows.count(), queries.count()
    groups, blocks = max(1, -(-total // TILE)), max(1, -(-asked // QUERY_TILE))
    branches = max(1, int(groups ** 0.5))

    tiles = rows.mapInArrow(_pack(TILE), _PACKED).withColumn(
        "group", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    # Written once, so that a tile keeps its number: rows may be dealt otherwise when they are dealt again.
    query_tiles = (checkpointed(queries.repartition(blocks).mapInArrow(_pack(QUERY_TILE), _PACKED))
                   .select(F.col("tile").alias("query_tile"), F.col("width").alias("q_width"),
                           F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
                   # A stated set of queries against all rows: every block of queries goes to every group.
                   .withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                             F.lit(groups - 1).cast("bigint")))))
    pairs = (tiles.join(query_tiles, "group").where("width = q_width")
             .withColumn("branch", F.pmod("group", F.lit(branches)))
             .select("query_tile", "branch", "width", "ids", "nulls", "matrix", "q_ids", "q_matrix"))
    lists = pairs.mapInArrow(_best(k), _LISTS)

    def merged(frame: DataFrame, *by: str) -> DataFrame:
        best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
        return frame.groupBy(*by).agg(best.alias("best"))

    tree = merged(lists, "query_tile", "query_row", "query_id", "branch")
    tree = merged(tree, "query_tile", "query_row", "query_id")
    return tree.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.low")).alias("score"))
