"""Byte-level BPE encoding and decoding with DuckDB in each task.

Encoding. A rank file (tiktoken's form) and a pattern give the vocabulary. Each match of the pattern is a word;
the words of a batch that are new and no token themselves go, all together, through one recursive query: rows are token
positions of a word, they join the table of merges with the position behind, each word's leftmost pair of minimum rank
is contracted, until no pair is left.

A word longer than ``WINDOW`` bytes goes through in overlapping windows. Encodings of neighbours are joined at a token
that both have at the same place: a sequence in which all neighbours may stand side by side is the
encoding, and so the result is exact. Where no token agrees, as in long runs of a character, the word is walked through
window by window, each beginning at a token's end.

Decoding joins positions with the vocabulary and aggregates the pieces in their order.

Ids travel as bytes, little-endian and 32 bits each. Tables given to DuckDB are bounded, so is what a worker remembers.

Defined results: a NULL or empty text has no ids and decodes to no bytes; bytes that are no UTF-8 count as replacement characters; ids outside the vocabulary decode to nothing;
NULL ids are none; repeated rows give a row each; an empty table gives no rows; a column named as one of the outputs is
replaced by it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.llm.arrow import as_text, kept, replaced, texts
from waybill.llm.frames import named, unpacked, whole

BYTES_AT_ONCE = 1_000_000
#: Matches remembered by a worker before it starts anew.
REMEMBERED = 250_000
#: Bytes of a window of a long word, and its overlap with the next.
WINDOW, OVERLAP = 160, 48
#: Rows that one recursive query may make in all.
ROWS = 400_000

# A position holds its token, the token behind it and where that one is. ``packed`` holds rank, place and next place.
_CONTRACT = """
with recursive token(step, word, place, id, next_id, next_place) as (
    select 0, word, place, id, lead(id) over along, coalesce(lead(place) over along, -1)
    from start window along as (partition by word order by place)
  union all (
    with best as (
        select word, min((merge.id::bigint << 44) | (place::bigint << 22) | next_place) as packed
        from token join merge on merge.first = token.id and merge.second = token.next_id
        group by word),
    pair as (
        select best.word, (packed >> 44)::int as id, ((packed >> 22) & 4194303)::int as place,
               token.place as gone, token.next_id, token.next_place
        from best join token on token.word = best.word and token.place = (packed & 4194303)::int)
    select step + 1, token.word, token.place,
           case when token.place = pair.place then pair.id else token.id end,
           case when token.place = pair.place then pair.next_id
                when token.next_place = pair.place then pair.id else token.next_id end,
           case when token.place = pair.place then pair.next_place else token.next_place end
    from token join pair on token.word = pair.word where token.place <> pair.gone))
select word, id
from token semi join (select word, max(step) as step from token group by word) using (word, step)
order by word, place
"""
_DECODE = """
select row, unhex(string_agg(piece, '')) as bytes
from (select row, place, piece from sequence join vocabulary using (id) order by row, place)
group by row
"""


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Engine:
    """An engine of one thread and bounded memory, with tables given from outside."""

    def __init__(self):
        import duckdb

        self.engine = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})

    def _table(self, name: str, **columns):
        given = pa.table({c: v if isinstance(v, np.ndarray) or isinstance(v[0], str) else pa.array(v, pa.int32())
                          for c, v in columns.items()})
        self.engine.register("given", given)
        self.engine.execute(f"create or replace temp table {name} as select * from given")
        self.engine.unregister("given")


class _Walk:
    """How far a word is encoded."""

    def __init__(self, word: bytes):
        self.word, self.ids, self.at = word, [], 0
        self.length, self.refused, self.done = WINDOW, set(), False

    def window(self) -> bytes:
        return self.word[self.at:self.at + self.length]

    def take(self, ids: list[int], size: dict[int, int]) -> None:
        """The tokens of the window up to the last border that may hold; all of the last window."""
        if self.at + self.length >= len(self.word):
            self.ids += ids
            self.done = True
            return
        ends = (self.at + np.cumsum([size[i] for i in ids])).tolist()
        certain = self.at + self.length * (WINDOW - OVERLAP) // WINDOW
        few = max((k for k, end in enumerate(ends, 1) if end <= certain and end not in self.refused), default=0)
        if few:
            self.ids += ids[:few]
            self.at = ends[few - 1]
        else:
            self.length *= 2

    def back(self, size: dict[int, int]) -> None:
        """The border does not hold."""
        self.refused.add(self.at)
        self.at -= size[self.ids.pop()]


class Encoder(_Engine):
    def __init__(self, path: str, pattern: str):
        super().__init__()
        ranks = _ranks(path)
        self.size = {i: len(t) for t, i in ranks.items()}
        self.bytes = {i: t for t, i in ranks.items()}
        self.known = {t: np.array([i], "<u4").tobytes() for t, i in ranks.items()}
        self.split = _splitter(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items()
                  for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._table("merge", first=[m[0] for m in merges], second=[m[1] for m in merges],
                    id=[m[2] for m in merges])
        self.match: dict[str, bytes] = {}  # a match of the pattern to its ids

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, by recursive queries of bounded size."""
        out: list[bytes] = []
        cost = np.cumsum([len(w) ** 2 for w in words]) // (2 * ROWS)
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(cost)) + 1):
            own = words[part[0]:part[-1] + 1]
            length = np.array([len(w) for w in own])
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            self._table("start", word=np.repeat(np.arange(len(own), dtype=np.int32), length),
                        place=place.astype(np.int32), id=self.byte[np.frombuffer(b"".join(own), np.uint8)])
            found = self.engine.execute(_CONTRACT).fetchnumpy()
            ids = np.ascontiguousarray(found["id"]).astype("<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(found["word"], minlength=len(own)))).tolist()
            out.extend(ids[i:j] for i, j in zip([0, *ends], ends))
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of any length."""
        out: list[bytes | None] = [self.known.get(w) for w in words]
        window, overlap = WINDOW, OVERLAP
        short = [i for i, ids in enumerate(out) if ids is None and len(words[i]) <= window]
        for i, ids in zip(short, self._contract([words[i] for i in short]) if short else []):
            out[i] = ids
        todo = [i for i, ids in enumerate(out) if ids is None]
        places = [range(0, max(1, len(words[i]) - overlap), window - overlap) for i in todo]
        pieces = list(dict.fromkeys(words[i][at:at + window] for i, ats in zip(todo, places) for at in ats))
        encoded = dict(zip(pieces, self._contract(pieces))) if pieces else {}
        for i, ats in zip(todo, places):
            ids = self._joined([(at, np.frombuffer(encoded[words[i][at:at + window]], "<u4").tolist()) for at in ats])
            out[i] = ids and np.array(ids, "<u4").tobytes()
        todo = [i for i in todo if out[i] is None]
        for i, ids in zip(todo, self._stepwise([words[i] for i in todo])):
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _stepwise(self, words: list[bytes]) -> list[list[int]]:
        """Ids of long words, window by window. A window begins where a token of the one before ends; the border holds if the two
        tokens at it may stand side by side, which is to say that their bytes alone become these two. Else an earlier border is
        tried, and a larger window where none is left. Windows of one content are encoded once."""
        known: dict[bytes, list[int]] = {}

        def learn(texts: list[bytes]) -> None:
            new = list(dict.fromkeys(t for t in texts if t not in known))
            if len(known) + len(new) > REMEMBERED // 10:
                known.clear()
                new = list(dict.fromkeys(texts))
            if new:
                known.update((t, np.frombuffer(ids, "<u4").tolist()) for t, ids in zip(new, self._contract(new)))

        walks = [_Walk(w) for w in words]
        while (open_ := [w for w in walks if not w.done]):
            learn([w.window() for w in open_])
            found = [(w, known[w.window()]) for w in open_]
            borders = [(w, ids, self.bytes[w.ids[-1]] + self.bytes[ids[0]]) for w, ids in found if w.ids]
            learn([pair for _, _, pair in borders])
            wrong = {id(w) for w, ids, pair in borders if known[pair] != [w.ids[-1], ids[0]]}
            for w, ids in found:
                if id(w) in wrong:
                    w.back(self.size)
                else:
                    w.take(ids, self.size)
        return [w.ids for w in walks]

    def _joined(self, windows: list[tuple[int, list[int]]]) -> list[int] | None:
        """The encoding of a word from those of its windows; None where two don't share a token."""
        ids, ends = [], {}  # where each token ends, to (place in ids, token)
        for at, more in windows:
            if not ids:
                start, rest = at, 0
            else:
                place = at
                for k, token in enumerate(more):
                    place += self.size[token]
                    # The first token of a window may be cut off, so may the last: a shared one is whole.
                    if ends.get(place, (0, -1))[1] == token:
                        start, rest = place, k + 1
                        del ids[ends[place][0] + 1:]
                        break
                else:
                    return None
            place = start
            ends = {e: v for e, v in ends.items() if v[0] < len(ids)}
            for token in more[rest:]:
                place += self.size[token]
                ends[place] = (len(ids), token)
                ids.append(token)
            ends = {e: v for e, v in ends.items() if e > at}
        return ids

    def encode(self, rows: list[str]) -> list[bytes]:
        matches = [self.split(r) for r in rows]
        known = self.match
        new = sorted(set().union(*matches).difference(known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = sorted(set().union(*matches))
        known.update(zip(new, self.encode_words([m.encode() for m in new])))
        return [b"".join([known[m] for m in found]) for found in matches]


class Decoder(_Engine):
    def __init__(self, path: str):
        super().__init__()
        ranks = _ranks(path)
        self._table("vocabulary", id=list(ranks.values()), piece=[t.hex() for t in ranks])

    def decode(self, rows: list[bytes]) -> list[bytes]:
        length = np.array([len(r) // 4 for r in rows], np.int64)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        self._table("sequence", row=np.repeat(np.arange(len(rows), dtype=np.int32), length),
                    place=place.astype(np.int32), id=np.frombuffer(b"".join(rows), "<u4").astype(np.int64))
        found = dict(self.engine.execute(_DECODE).fetchall())
        return [found.get(i, b"") for i in range(len(rows))]


def _splitter(pattern: str):
    """A function from a text to the matches of the pattern, with the classes as the rank file's library has them.

    The libraries may know different versions of Unicode. Texts with a character that they class differently are matched
    by a pattern that spells the classes out.
    """
    import regex
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    spelled, differ = {}, set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        library = tiktoken.Encoding("class", pat_str=kind + "+", mergeable_ranks=single, special_tokens={})
        there = bytes(library.encode_ordinary(every)).decode()
        differ |= set(there) ^ set("".join(regex.findall(kind + "+", every)))
        codes = np.frombuffer(there.encode("utf-32-le"), np.uint32)
        runs = np.split(codes, np.flatnonzero(np.diff(codes) != 1) + 1)
        spelled[kind] = "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)
    usual = regex.compile(pattern).findall
    if not differ:
        return usual
    letter, number, space = spelled.values()
    exact = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    for old, new in ((r"\p{L}", letter), (r"\p{N}", number), (r"\S", "^" + space), (r"\s", space)):
        exact = exact.replace(old, f"[{new}]")
    exactly, same = re.compile(exact).findall, frozenset(differ).isdisjoint
    return lambda text: (usual if text.isascii() or same(text) else exactly)(text)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids",
           n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with the ids of the text in place of the text, and their number."""
    keep = [c for c in docs.columns if c not in (text, ids, n_tokens)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(Encoder, ranks, pattern)
        for batch, rows in texts(batches, BYTES_AT_ONCE):
            found = encoder.encode([as_text(r) for r in rows])
            yield replaced(batch, ["row"], n_tokens=pa.array([len(i) // 4 for i in found], pa.int64()), ids=pa.array(found, pa.binary()))

    rows = docs.select(whole(keep), named(text).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    found = rows.mapInArrow(run, schema)
    return found.select(*unpacked(keep), found["n_tokens"].alias(n_tokens), found["ids"].alias(ids))


def decode(tokens: DataFrame, ranks: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that the ids stand for in place of the ids."""
    keep = [c for c in tokens.columns if c not in (ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = kept(Decoder, ranks)
        for batch, rows in texts(batches, BYTES_AT_ONCE, "ids"):
            yield replaced(batch, ["row"], decoded=pa.array(decoder.decode(rows), pa.binary()))

    rows = tokens.select(whole(keep), named(ids).alias("ids"))
    schema = T.StructType([rows.schema["row"], T.StructField("decoded", T.BinaryType())])
    found = rows.mapInArrow(run, schema)
    return found.select(*unpacked(keep), found["decoded"].alias(decoded))


def _both(ranks: str, pattern: str) -> tuple[Encoder, Decoder]:
    return Encoder(ranks, pattern), Decoder(ranks)


def round_trip(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode the ids: key, n_tokens and the SHA-256 of the ids and of the decoded bytes.

    ``encode`` and ``decode`` in one pass, so that a task needs one worker.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = kept(_both, ranks, pattern)
        for batch, rows in texts(batches, BYTES_AT_ONCE):
            ids = encoder.encode([as_text(r) for r in rows])
            yield replaced(batch, ["key"], n_tokens=pa.array([len(i) // 4 for i in ids], pa.int64()),
                           ids=pa.array(ids, pa.binary()), decoded=pa.array(decoder.decode(ids), pa.binary()))

    rows = docs.select(named(key).alias("key"), named(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    both = rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids binary, decoded binary")
    return both.select(F.col("key").alias(key), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
