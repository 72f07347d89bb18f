"""Token ids as binary files with a minimal perfect hash index.

Layout of a folder, all numbers little-endian:

* ``shard-<n>.ids``: the ids of the shard's documents one after the other, ``width`` bytes each, nothing else;
* ``index-<n>.mph``: the index of the documents whose key hashes to ``n``. Header: the number of keys, of buckets,
  of shards (three u64); then the displacement of each bucket (u32); then, by slot, fingerprints (u64), shards (u32),
  lengths (u64) and offsets in the shard (u64), both in ids.

A key is looked up in constant time: its hash gives the index file and a bucket, the bucket's displacement the
slot; the slot's fingerprint must be the key's, else the key isn't there. The hash is minimal and perfect: there are as
many slots as keys and no two keys share one (displacements are searched from the fullest buckets on; a bucket of one
key names one of the slots left).

Keys may repeat and may be NULL: a key is (document key, running number among its copies).

Documents are ranged over shards by key, so the shards hold them in ascending order; ids before a document are those of the
shards before (one number per shard) and those before it in its shard. Tasks write to a name of their own and
move the file when it is whole, and the content depends on the data alone, so a task may run again.

Defined results: a NULL text has the end id only; ties of key go by text; a NULL key comes last; an
empty table makes no files and gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.arrow import as_text, kept, texts
from waybill.llm.chat import positions
from waybill.llm.frames import checkpointed

BYTES_AT_ONCE = 4_000_000
REMEMBERED = 1_000_000
WORDS_AT_ONCE = 100_000
#: Keys of an index file, on average; keys of a bucket of the hash.
KEYS_PER_INDEX = 200_000
PER_BUCKET = 4


def _files(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _written(folder: str, name: str, chunks) -> None:
    """Write a file under a name of this attempt, then move it to its place."""
    files, path = _files(folder)
    files.create_dir(path)
    attempt = f"{path}/_{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(attempt) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(attempt, f"{path}/{name}")


def _runs(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``start``, one after the other."""
    stop = np.cumsum(length)
    return values[np.repeat(start - stop + length, length) + np.arange(length.sum())]


class WordTokenizer:
    """A ``tokenizers`` file whose words are encoded once and remembered.

    The file's normaliser lowers letters and its splitter drops white space and parts letters and digits from marks;
    its special strings hold no white space and begin with ``<|``. So a text's ids are those of its words, ASCII letters may
    be lowered before (where no special string can be), and the marks at the end of a word are a word of their own.

    Each distinct word of the rows given at once is looked up once. Words of plain letters, which the normaliser only lowers
    and the splitter leaves whole, go straight to the file's model.
    """

    _marks = tuple(bytes([c]) for c in b".,;:!?#$%&*")
    _marked = re.compile(rb"([^\x20\x09-\x0d]*[a-z0-9])(?:[.,;:!?]|[.,;:!?]?[#$%&*]+)")
    _plain = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code, self.dtype = ("H", "<u2") if self.tokenizer.get_vocab_size() <= 65536 else ("I", "<u4")
        self.known: dict[bytes, bytes] = {}
        # Letters beyond ASCII as the model has them: a character for each byte.
        by_byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: by_byte.pre_tokenize_str(chr(c).lower())[0][0] for c in range(0xC0, 0x100)}

    def encode(self, rows: list[bytes]) -> list[bytes]:
        lowered = pa.array([r if b"<|" in r else r.lower() for r in rows], pa.large_binary()).view(pa.large_string())
        split = pc.ascii_split_whitespace(lowered)
        numbers = pc.dictionary_encode(split.flatten())
        words = numbers.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        if None in found:
            self._learn([w for w, f in zip(words, found) if f is None], words)
            found = list(map(self.known.__getitem__, words))
        # The ids of all words of all rows, gathered out of those of the distinct words.
        ids = np.frombuffer(b"".join(found), self.dtype)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        starts, number = np.cumsum(lengths) - lengths, numbers.indices.to_numpy()
        stops = np.append(0, np.cumsum(lengths[number]))
        every = b"".join(_runs(ids, starts[n], lengths[n]).tobytes()
                         for n in (number[i:i + WORDS_AT_ONCE] for i in range(0, len(number), WORDS_AT_ONCE)))
        ends = (stops[split.offsets.to_numpy()] * ids.itemsize).tolist()
        return [every[i:j] for i, j in zip(ends, ends[1:])]

    def _learn(self, words: list[bytes], wanted: list[bytes]) -> None:
        """Encode ``words``, which are not known. A word that ends in marks is made of its two parts. Beyond the bound
        only the ``wanted`` words stay known."""
        known = self.known
        marked = {w: m.end(1) for w in words if w.endswith(self._marks) and b"<|" not in w and (m := self._marked.fullmatch(w))}
        parts = {p for w, at in marked.items() for p in (w[:at], w[at:])}
        new = parts.union(w for w in words if w not in marked).difference(known)
        if len(known) + len(new) + len(marked) > REMEMBERED:
            stay = {w: known[w] for w in parts.union(wanted) if w in known}
            known.clear()
            known.update(stay)
        self._encode(list(new))
        known.update((w, known[w[:at]] + known[w[at:]]) for w, at in marked.items())

    def _encode(self, new: list[bytes]) -> None:
        tokenize, plain, rest = self.model.tokenize, self._plain.fullmatch, []
        for word in new:
            text = as_text(word)
            if plain(text):
                ids = [t.id for t in tokenize(text if text.isascii() else text.translate(self.letters))]
                self.known[word] = array(self.code, ids).tobytes()
            else:
                rest.append((word, text))
        for i in range(0, len(rest), 10_000):
            part = rest[i:i + 10_000]
            encoded = self.tokenizer.encode_batch_fast([text for _, text in part], add_special_tokens=False)
            self.known.update((w, array(self.code, e.ids).tobytes()) for (w, _), e in zip(part, encoded))


# -- the hash -------------------------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: A displacement with this bit set is the slot itself: buckets with one key take what is left.
_DIRECT = 1 << 31


def _slots(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = _mix(h + displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (mixed % np.uint64(n)).astype(np.int64)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(h ^ np.uint64(0xA5A5A5A5)) % np.uint64(buckets)).astype(np.int64)


def slots(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    """The slot of each hash, given the displacements of all buckets."""
    own = displacement[_buckets(h, len(displacement))].astype(np.int64)
    return np.where(own & _DIRECT, own & (_DIRECT - 1), _slots(h, own & (_DIRECT - 1), n))


def perfect_hash(h: np.ndarray) -> np.ndarray:
    """Displacements of the buckets such that all (distinct) hashes have slots of their own."""
    n = len(h)
    buckets = max(1, -(-n // PER_BUCKET))
    bucket = _buckets(h, buckets)
    size = np.bincount(bucket, minlength=buckets)
    order = np.argsort(bucket, kind="stable")
    start = np.cumsum(size) - size
    displacement, free = np.zeros(buckets, np.uint32), np.ones(n, bool)
    for width in range(int(size.max(initial=0)), 1, -1):
        todo = np.flatnonzero(size == width)
        keys = h[order[start[todo][:, None] + np.arange(width)]]
        tried = 0
        while len(todo):
            # All buckets of a size try some displacements at once, few while they are many. Of those that
            # fit and want one slot the first has it.
            tries = max(1, min(4096, 200_000 // (len(todo) * width)))
            slot = _slots(keys[:, None, :], np.arange(tried, tried + tries)[None, :, None], n)
            ranked = np.sort(slot, axis=2)
            fits = free[slot].all(axis=2) & (ranked[:, :, 1:] != ranked[:, :, :-1]).all(axis=2)
            hit = np.argmax(fits, axis=1)
            at = np.flatnonzero(fits[np.arange(len(todo)), hit])
            wanted = slot[at, hit[at]]
            first = np.zeros(wanted.size, bool)
            first[np.unique(wanted.ravel(), return_index=True)[1]] = True
            won = first.reshape(wanted.shape).all(axis=1)
            displacement[todo[at[won]]] = tried + hit[at[won]]
            free[wanted[won].ravel()] = False
            rest = np.ones(len(todo), bool)
            rest[at[won]] = False
            # A bucket that lost a fitting slot may find another among the same displacements.
            tried += 0 if len(at) > won.sum() and tries > 1 else tries
            todo, keys = todo[rest], keys[rest]
    single = np.flatnonzero(size == 1)
    displacement[single] = np.flatnonzero(free)[:len(single)].astype(np.uint32) | np.uint32(_DIRECT)
    return displacement


class Index:
    """One index file, read whole; its size is bounded by ``KEYS_PER_INDEX``."""

    def __init__(self, data: bytes):
        n, buckets, _, more = map(int, np.frombuffer(data, "<u8", 4))
        self.n, self.buckets, every, at = n, buckets, n + more, 32
        self.displacement = np.frombuffer(data, "<u4", buckets, at)
        at += 4 * buckets
        self.fingerprint = np.frombuffer(data, "<u8", every, at)
        self.shard = np.frombuffer(data, "<u4", every, at + 8 * every)
        self.length = np.frombuffer(data, "<u8", every, at + 12 * every)
        self.offset = np.frombuffer(data, "<u8", every, at + 20 * every)
        self.repeated = np.frombuffer(data, "<u8", more, at + 28 * every)

    @staticmethod
    def build(h: np.ndarray, fingerprint: np.ndarray, shard, length, offset) -> list[bytes]:
        """Of keys whose hashes are equal the first has a slot; the others follow the slots, with their hashes."""
        first = np.unique(h, return_index=True)[1]
        rest = np.setdiff1d(np.arange(len(h)), first)
        displacement = perfect_hash(h[first])
        back = np.empty(len(first), np.int64)
        back[slots(h[first], displacement, len(first))] = first
        back = np.append(back, rest)
        head = np.array([len(first), len(displacement), len(np.unique(shard)), len(rest)], "<u8")
        return [head.tobytes(), displacement.astype("<u4").tobytes(), fingerprint[back].astype("<u8").tobytes(),
                shard[back].astype("<u4").tobytes(), length[back].astype("<u8").tobytes(),
                offset[back].astype("<u8").tobytes(), h[rest].astype("<u8").tobytes()]

    def find(self, h: np.ndarray, fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys, and whether each is there."""
        slot = slots(h, self.displacement, self.n)
        for k, repeated in enumerate(self.repeated, self.n):
            slot = np.where((h == repeated) & (fingerprint == self.fingerprint[k]), k, slot)
        return slot, self.fingerprint[slot] == fingerprint


# -- writing --------------------------------------------------------------------------------------

def _write_shards(tokenizer: str, folder: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        words = kept(WordTokenizer, tokenizer)
        keys, lengths = [], []
        last = np.array([end], words.dtype).tobytes()

        def payload():
            for batch, rows in texts(batches, BYTES_AT_ONCE):
                found = words.encode(rows)
                keys.append(batch.column("key"))
                lengths.extend(len(f) // len(last) + 1 for f in found)
                yield b"".join(f + last for f in found)

        first = next(chunks := payload(), None)
        if first is None:
            return
        _written(folder, f"shard-{shard:06d}.ids", (c for part in ([first], chunks) for c in part))
        length = np.array(lengths, np.int64)
        key = pa.chunked_array(keys).combine_chunks()
        offset = np.cumsum(length) - length
        for i in range(0, len(length), 50_000):
            part = slice(i, i + 50_000)
            n = len(length[part])
            yield pa.RecordBatch.from_arrays(
                [key[i:i + n], pa.array(np.full(n, shard, np.int64)), pa.array(offset[part]), pa.array(length[part])],
                names=["key", "shard", "offset", "n_tokens"])
    return run


def _hashes() -> dict[str, Column]:
    key = [F.col("key").cast("string"), F.col("copy")]
    return {"h": F.xxhash64(*key), "fingerprint": F.xxhash64(F.lit("fingerprint"), *key)}


def _index_of(files: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("index"), F.col("h")), F.lit(files)).cast("int")


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _write_index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [_columns(b, "index", "h", "fingerprint", "shard", "n_tokens", "offset") for b in batches if b.num_rows]
        if not rows:
            return
        index, h, fingerprint, shard, length, offset = map(np.concatenate, zip(*rows))
        for i in np.unique(index):
            own = index == i
            _written(folder, f"index-{i:06d}.mph", Index.build(
                h[own].view(np.uint64), fingerprint[own].view(np.uint64), shard[own], length[own], offset[own]))
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([int(own.sum())], pa.int64())],
                                             names=["index", "keys"])
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int, shards: int | None = None, key: str = "doc_id",
                      text: str = "text") -> tuple[DataFrame, int]:
    """Write shards and indexes; the directory (key, copy, shard, offset, n_tokens, start), and the number of
    index files. The directory is a table written along the way, of narrow rows. There are as many shards as the session
    has shuffle partitions, unless given."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # Ties are ranged by text, so different texts of one key don't meet in one shard.
    order = [F.col("key").asc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    kind = rows.schema["key"].dataType.simpleString()
    written = checkpointed(ranged.mapInArrow(_write_shards(tokenizer, folder, end),
                                             f"key {kind}, shard bigint, offset bigint, n_tokens bigint"))
    # One row per shard: ids before it.
    before = written.groupBy("shard").agg(F.sum("n_tokens").alias("_ids"))
    along = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_ids").over(along), F.lit(0)).alias("_before"))
    # Copies of a key are numbered by place. A key alone has number 0 without any sorting.
    repeated = written.groupBy("key").agg(F.count("*").alias("_copies")).where("_copies > 1").withColumnRenamed("key", "_key")
    placed = (written.join(before, F.col("shard") == F.col("_shard"))
              .withColumn("start", F.col("_before") + F.col("offset")).drop("_shard", "_before"))
    placed = placed.join(repeated, F.col("key").eqNullSafe(F.col("_key")), "left")
    copies = placed.where("_copies > 1")
    single = placed.where("_copies is null").withColumn("copy", F.lit(0).cast("bigint"))
    numbered = positions(copies.drop("_copies", "_key"), "key", [F.col("start")]).withColumnRenamed("position", "copy")
    directory = checkpointed(single.drop("_copies", "_key").unionByName(numbered))
    files = max(1, -(-directory.count() // KEYS_PER_INDEX))
    entries = (directory.withColumns(_hashes()).withColumn("index", _index_of(files))
               .select("index", "h", "fingerprint", "shard", "n_tokens", "offset").repartition(files, "index"))
    entries.mapInArrow(_write_index(folder), "index int, keys bigint").agg(F.sum("keys")).first()
    return directory, files


def shard_starts(directory: DataFrame) -> DataFrame:
    """Ids before each shard, one row per shard."""
    return directory.select("shard", (F.col("start") - F.col("offset")).alias("before")).groupBy("shard").agg(
        F.first("before").alias("before"))


def with_start(places: DataFrame, starts: DataFrame) -> DataFrame:
    """``places`` (with shard and offset) with ``start``, the ids of all documents before."""
    return (places.join(starts.withColumnRenamed("shard", "_shard"), F.col("shard") == F.col("_shard"))
            .withColumn("start", F.col("before") + F.col("offset")).drop("_shard", "before"))


# -- reading --------------------------------------------------------------------------------------

def _read(folder: str, name: str, start: int = 0, length: int | None = None) -> bytes:
    files, path = _files(folder)
    with files.open_input_file(f"{path}/{name}") as source:
        return source.read() if length is None else source.read_at(length, start)


def _look_up(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Index] | None = None
        for batch in batches:
            index, h, fingerprint = _columns(batch, "index", "h", "fingerprint")
            for i in np.unique(index):
                if held is None or held[0] != i:
                    held = (i, Index(_read(folder, f"index-{i:06d}.mph")))
                at = np.flatnonzero(index == i)
                slot, there = held[1].find(h[at].view(np.uint64), fingerprint[at].view(np.uint64))
                at, slot = at[there], slot[there]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(at)), batch.column("copy").take(pa.array(at)),
                     *[pa.array(getattr(held[1], c)[slot].astype(np.int64)) for c in ("shard", "offset", "length")]],
                    names=["key", "copy", "shard", "offset", "n_tokens"])
    return run


def find(keys: DataFrame, folder: str, files: int) -> DataFrame:
    """Where documents are: ``keys`` (key, copy) to key, copy, shard, offset, n_tokens. Unknown keys give no row."""
    kind = keys.schema["key"].dataType.simpleString()
    asked = (keys.select("key", "copy").withColumns(_hashes()).withColumn("index", _index_of(files))
             .withColumn("salt", F.pmod("fingerprint", F.lit(16))).repartition("index", "salt")
             .sortWithinPartitions("index").drop("salt"))
    return asked.mapInArrow(_look_up(folder), f"key {kind}, copy bigint, shard bigint, offset bigint, n_tokens bigint")


def _payload(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        held, source = None, None
        try:
            for batch in batches:
                shard, offset, length = _columns(batch, "shard", "offset", "n_tokens")
                done = 0
                while done < batch.num_rows:
                    out, n = [], done
                    while n < batch.num_rows and sum(map(len, out)) < BYTES_AT_ONCE:
                        if held != shard[n]:
                            if source is not None:
                                source.close()
                            held, source = shard[n], files.open_input_file(f"{path}/shard-{shard[n]:06d}.ids")
                        ids = source.read_at(int(length[n]) * width, int(offset[n]) * width)
                        out.append(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                        n += 1
                    part = batch.slice(done, n - done)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())],
                                                     names=[*part.schema.names, "ids"])
                    done = n
        finally:
            if source is not None:
                source.close()
    return run


def read_ids(places: DataFrame, folder: str, width: int) -> DataFrame:
    """``places`` (with shard, offset, n_tokens) with the ids, little-endian and 32 bits each."""
    schema = ", ".join(f"`{c}` {t}" for c, t in places.dtypes) + ", ids binary"
    ordered = places.repartition("shard").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(_payload(folder, width), schema)
