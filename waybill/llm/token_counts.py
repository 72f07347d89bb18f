"""Token counts of whole texts, by the transducer compiled from a vocabulary.

Each worker compiles its own transducer, of bounded size, and keeps it from task to task; no rows are moved. Defined results: a NULL or empty text has 0 bytes and 0
tokens; texts of any length are read in chunks; repeated rows give a row each; an empty table gives no rows; columns
other than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.arrow import kept, replaced, texts
from waybill.llm.transducer import Transducer, Vocabulary

CHUNK = 1024
BYTES_AT_ONCE = 4_000_000


def _transducer(model: str) -> Transducer:
    return Transducer(Vocabulary(model))


def _counter(model: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = kept(_transducer, model)
        for batch, rows in texts(batches, BYTES_AT_ONCE):
            yield replaced(batch, ["key"], n_bytes=pa.array([len(r) for r in rows], pa.int64()),
                           n_tokens=pa.array(transducer.count(rows, chunk), pa.int64()))
    return run


def count_tokens(docs: DataFrame, model: str, limit: int, key: str = "doc_id", text: str = "text",
                 chunk: int = CHUNK) -> DataFrame:
    """Columns key, n_bytes, n_tokens, over_limit. ``model`` is a sentencepiece BPE file every executor has."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(_counter(model, chunk), f"key {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
