"""Periodic runs of words in texts, found by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that is long enough, ``LEAST`` words and
``EXPONENT`` periods, and that no neighbouring word extends with that period. A worker makes one run-length grammar (``recompression``)
for the texts of a slice, a symbol of its own behind each, and finds their runs from it:

* candidates: for each period p the places of a grid of ``(EXPONENT - 1) * p`` words, as a run of that length has such a place and
  the one p words behind it inside; n / p places for each p, so a harmonic sum, n log n in all;
* the grammar's longest common extensions of the two places, forward and back, give the exact stretch with period p;
* of equal stretches the smallest period is theirs. A stretch of period p that has a smaller one, q, is also the whole
  stretch of q, as it is long enough for q to divide p.

Rows go to tasks as they lie; nothing is shuffled. A slice holds ``BYTES_AT_ONCE`` of text or one row, so memory is bounded by that or
by the longest text (some 300 bytes a word).

Defined results: a NULL or empty text, or one of white space, has no runs and collapses to the empty text; bytes that are no
UTF-8 pass as they are; repeated rows give a row each; an empty table gives no rows; a column named as an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waybill.llm.arrow import replaced, texts
from waybill.llm.frames import named, unpacked, whole
from waybill.llm.recompression import Grammar

LEAST, EXPONENT = 6, 4
BYTES_AT_ONCE = 2_000_000
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def candidates(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of these lengths: sequence, place and period of each grid point."""
    most = np.where(length >= LEAST, length // EXPONENT, 0)
    sequence = np.repeat(np.arange(len(length)), most)
    period = np.arange(len(sequence)) - np.repeat(np.cumsum(most) - most, most) + 1
    grid = np.maximum((EXPONENT - 1) * period, LEAST - period)
    points = -(-(length[sequence] - period) // grid)
    which = np.repeat(np.arange(len(sequence)), points)
    number = np.arange(len(which)) - np.repeat(np.cumsum(points) - points, points)
    return sequence[which], number * grid[which], period[which]


def find_runs(sequence: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of sequences that lie one after another, a number of its own behind each (not in ``length``).

    Start (place in ``sequence``), end and period, ordered by start, then period.
    """
    begin = np.cumsum(length + 1) - length - 1
    of, place, period = candidates(length)
    a = begin[of] + place
    b = a + period
    # The first word of the extension: most candidates end here.
    equal = sequence[a] == sequence[b]
    a, b, period = a[equal], b[equal], period[equal]
    if not len(a):
        return a, a, a
    grammar = Grammar(sequence, 2 * len(length))
    end = b + grammar.extension(a, b)
    start = a - grammar.extension(a - 1, b - 1, back=True)
    long_enough = end - start >= np.maximum(LEAST, EXPONENT * period)
    start, end, period = start[long_enough], end[long_enough], period[long_enough]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[:len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _of_texts(rows: list[bytes]) -> tuple[list[list[dict]], list[bytes]]:
    """Runs of each text, and the text without what repeats the first period of a run."""
    split = [r.split() for r in rows]
    number: dict[bytes, int] = {}
    length = np.fromiter(map(len, split), np.int64, len(rows))
    begin = np.cumsum(length + 1) - length - 1
    sequence = np.empty(int(length.sum()) + len(rows), np.int64)
    for at, words in zip(begin.tolist(), split):
        sequence[at:at + len(words)] = [number.setdefault(w, len(number)) for w in words]
    sequence[begin + length] = len(number) + np.arange(len(rows))
    start, end, period = find_runs(sequence, length)
    edges = np.searchsorted(start, np.append(begin, len(sequence)))
    runs, collapsed = [], []
    for i, words in enumerate(split):
        own = slice(edges[i], edges[i + 1])
        s, e, p = start[own] - begin[i], end[own] - begin[i], period[own]
        if len(s):
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, s + p, 1)
            np.add.at(cover, e, -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
        runs.append([{"start": x, "length": y - x, "period": z} for x, y, z in zip(s.tolist(), e.tolist(), p.tolist())])
        collapsed.append(b" ".join(words))
    return runs, collapsed


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of the text (by start, then period) and the collapsed text in place of the text."""
    keep = [c for c in docs.columns if c not in (text, runs, collapsed)]
    rows = docs.select(whole(keep), named(text).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in texts(batches, BYTES_AT_ONCE):
            found, rest = _of_texts(some)
            yield replaced(batch, ["row"], runs=pa.array(found, kind), collapsed=pa.array(rest, pa.binary()))

    schema = T.StructType([rows.schema["row"], T.StructField("runs", T.DataType.fromDDL(_RUNS)),
                           T.StructField("collapsed", T.BinaryType())])
    found = rows.mapInArrow(run, schema)
    return found.select(*unpacked(keep), found["runs"].alias(runs), found["collapsed"].alias(collapsed))
