"""Batches of bounded bytes for functions that see Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from typing import Any

import pyarrow as pa

_kept: dict[tuple, Any] = {}


def kept(make: Callable, *arguments) -> Any:
    """``make(*arguments)``, kept by a worker from task to task: the last one asked for, so that the memories of different
    operators don't add up."""
    key = (make, *arguments)
    if key not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            with suppress(AttributeError):  # only glibc has it: give freed memory back
                ctypes.CDLL(None).malloc_trim(0)
        _kept[key] = make(*arguments)
    return _kept[key]


def texts(batches: Iterator[pa.RecordBatch], most: int, text: str = "text", inside: str | None = None
          ) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of at most ``most`` bytes of text (or one row), each with its texts as UTF-8; NULL is empty.

    ``inside``: the struct column that holds the text.
    """
    for batch in batches:
        column = None
        if batch.num_rows:
            column = batch.column(text) if inside is None else batch.column(inside).field(text)
            column = column.cast(pa.binary())
        start = held = 0
        rows: list[bytes] = []
        for i in range(batch.num_rows):
            value = column[i].as_py() or b""
            if rows and held + len(value) > most:
                yield batch.slice(start, len(rows)), rows
                start, held, rows = i, 0, []
            rows.append(value)
            held += len(value)
        if rows:
            yield batch.slice(start, len(rows)), rows


def as_text(data: bytes) -> str:
    """Bytes that are no UTF-8, which a string column may hold, become replacement characters."""
    return data.decode("utf-8", "replace")


def replaced(batch: pa.RecordBatch, keep: list[str], **columns) -> pa.RecordBatch:
    """The named columns of a batch, and new ones."""
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(columns.values()),
                                      names=[*keep, *columns])
