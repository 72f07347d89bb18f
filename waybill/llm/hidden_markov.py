"""Language-model scores by a hidden Markov model trained on the corpus.

The model: latent states move from word to word, and a state emits each word of the training text with a probability of its own,
and with what is left any other word. So emissions grow with the vocabulary; they are held in parts, never in one place.

1. Texts become blocks: token numbers, and a dictionary of the block (64-bit hashes of its words, in order, with counts). A block is
   many rows, each of a few texts or words, so what Spark holds of a row is small however large a block is. They meet again by
   their block, in order: first the words, then the texts, which are walked through as they come.
2. Dictionaries are cut by hash ranges; the task of a range adds the counts of its words over all blocks and sends every block
   the totals of its words. No vocabulary is held whole anywhere: a range has ``WORDS_PER_RANGE`` entries on average.
3. Baum-Welch: every block adds up the expected counts of its training texts per word and state. They take the same way: the task
   of a range adds up those of its words over all blocks and sends every block its words' sums for the next pass. The driver
   holds starts, moves and a sum per state. All training texts take part in every pass; texts are learned from in stretches of
   ``STRETCH`` tokens. A text's later stretches begin with the states' shares of all tokens and don't count as starts; the one
   move across each cut is not counted.
4. Every whole text is scored by the scaled forward recursion.

A word's emissions lean on its smoothed count with the weight of ``LEAN`` tokens against its own count, so what a rare word was seen
with decides little; what a state's words lose by this is dealt out by the smoothed counts, so its emissions add up to 1 with all
unknown words as one. Emissions start from the smoothed counts with noise by the word's hash.

Words are told apart by 64-bit hashes: among V words V^2 / 2^65 pairs are expected to be taken for one.

What is written: the blocks, and one pass at a time. Expected counts travel as shares of the word's count in 16-bit floats, whose error of
0.05 % a share is far below the noise of the counts. The tables lie in a folder of their own below the shared one; each takes the
place of the one it follows from as soon as that is not needed any more, a pass is two steps (counts to the ranges, sums to the blocks), and
shuffle files go when their step is written. Files are written in groups of rows of some ``ROWS_BYTES``. The folder is the caller's to remove.

Defined results: a NULL or empty text is one end token; a NULL key counts as the empty text when texts are held out; repeated rows are
texts of their own; without training text all words are unknown; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm import hmm
from waybill.llm.arrow import texts
from waybill.llm.frames import kept_at, named
from waybill.llm.shingles import word_hashes
from waybill.session import fresh_folder

STATES, PASSES, SEED = 8, 5, 11
STRETCH = 512
BYTES_AT_ONCE = 2_000_000
#: Tokens of a block (or one text), and of the sequences that are walked through at once, which also are a row.
BLOCK_TOKENS, TOKENS_AT_ONCE = 2_000_000, 500_000
#: Words of a row, and of those whose emissions are worked out at once.
WORDS_AT_ONCE = 65_536
#: Of the rows that a writer, and later a reader, holds at once.
ROWS_BYTES = 8 << 20
WORDS_PER_RANGE = 500_000
SMOOTH = 0.1
LEAN = 5
#: Stands for the end; no word holds a space.
_END = b" "
#: What a row holds of its block, in the order in which the rows are read.
HASHES, TOTALS, SHARES, TEXTS = range(4)


def _packed(array: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), kind)


#: All 16-bit floats by their bits.
_HALVES = np.arange(1 << 16, dtype="<u2").view("<f2").astype("f4")


def halves(shares: np.ndarray) -> np.ndarray:
    """The bits of the nearest 16-bit floats. Those under 2^-14 count whole 2^-24ths; numpy takes many times as long for them."""
    small = shares < 2.0 ** -14
    out = np.where(small, 0, shares).astype("<f2").view("<u2")
    out[small] = np.rint(shares[small] * 2.0 ** 24)
    return out


@dataclass
class Model:
    """All that is not held per word."""
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    tokens: int  # of training text
    words: int  # distinct ones of it
    weight: np.ndarray  # (states,): what the emissions of a state add up to before they are divided by it
    leaning: float  # sum of lean x marginal over all words
    freed: np.ndarray | None = None  # (states,): what the words of a state have lost; None before the first pass

    def marginal(self, total: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts in training text; all unknown words are one."""
        return (total + SMOOTH) / (self.tokens + SMOOTH * (self.words + 1))

    def shares(self) -> np.ndarray:
        """Of all tokens in the pass before; those of the starts before the first."""
        return self.start if self.freed is None else self.weight / self.weight.sum()

    def emissions(self, total: np.ndarray, hashes: np.ndarray | None, counts: np.ndarray | None) -> np.ndarray:
        """Of words (rows) in states. ``counts``: expected counts of the pass before, None before the first, which needs hashes."""
        marginal = self.marginal(total)
        if counts is None:
            return marginal[:, None] * noise(hashes, total) / self.weight
        own = lean(total)
        out = counts * (1 - own).astype("f4")[:, None]
        out += np.multiply.outer((own * marginal / self.leaning).astype("f4"), self.freed.astype("f4"))
        out /= self.weight.astype("f4")
        return out


def lean(total: np.ndarray) -> np.ndarray:
    """The share of words' emissions that follows their smoothed counts; all of it for unknown words."""
    return LEAN / (total + LEAN)


def noise(hashes: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Numbers from 0.4 to 1.6 by word and state; 1 for unknown words."""
    with np.errstate(over="ignore"):
        mixed = hashes[:, None] + np.arange(1, STATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) * np.uint64(SEED)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
    return np.where(total[:, None] > 0, 0.4 + 1.2 * (mixed >> np.uint64(11)) / 2.0 ** 53, 1.0)


def _parts(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that a sorted dictionary has words of, and where each begins; the end last."""
    part = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    numbers = np.unique(part)
    return numbers.astype(np.int64), np.append(np.searchsorted(part, numbers), len(part))


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    """One row; NULL where no value is given."""
    return pa.RecordBatch.from_pylist([values], schema)


def _block(number: int, key_type: pa.DataType, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int64()), ("at", pa.int64()), ("keys", pa.list_(key_type)),
                        *[(name, pa.binary()) for name in ("learned", "lengths", "tokens", "hashes", "counts")], ("words", pa.int64())])
    keys = [k for some, *_ in held for k in some]
    learned, length, hashes = (np.concatenate([row[i] for row in held]) for i in (1, 2, 3))
    held.clear()
    words, token = np.unique(hashes, return_inverse=True)
    del hashes
    token = token.astype("<i4")
    count = np.bincount(token[np.repeat(learned, length)], minlength=len(words))
    for i in range(0, len(words), WORDS_AT_ONCE):
        some = slice(i, i + WORDS_AT_ONCE)
        yield _row(schema, block=number, kind=HASHES, at=i, hashes=words[some].astype("<u8").tobytes(),
                   counts=_packed(count[some].astype("<i8")), words=len(words[some]))
    for some, tokens in _slices(length, TOKENS_AT_ONCE):
        yield _row(schema, block=number, kind=TEXTS, at=int(some.start), keys=keys[some], learned=_packed(learned[some]),
                   lengths=_packed(length[some].astype("<i4")), tokens=_packed(token[tokens]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, held, tokens = TaskContext.get().partitionId() << 32, [], 0
    for batch, rows in texts(batches, BYTES_AT_ONCE):
        words: list[bytes] = []
        length = np.zeros(len(rows), np.int64)
        for i, row in enumerate(rows):
            found = row.lower().split()  # of bytes: A-Z and the ASCII white space
            length[i] = len(found) + 1
            words += found
            words.append(_END)
        if held and tokens + len(words) > BLOCK_TOKENS:
            number += 1
            yield from _block(number, batch.column("key").type, held)
            held, tokens = [], 0
        held.append((batch.column("key").to_pylist(), ~batch.column("held_out").to_numpy(zero_copy_only=False), length,
                     word_hashes(words)))
        tokens += len(words)
    if held:
        yield from _block(number + 1, batch.column("key").type, held)


def _cut(ranges: int):
    """Rows of blocks' dictionaries in parts, by ranges of the hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, first, data, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "hashes", "counts"))):
                hashes, count = np.frombuffer(data, "<u8"), _unpacked(packed, "<i8")
                numbers, at = _parts(hashes, ranges)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), pa.array(np.full(len(numbers), block), pa.int64()), pa.array(first + at[:-1], pa.int64()),
                     pa.array([hashes[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()),
                     pa.array([_packed(count[i:j]) for i, j in zip(at, at[1:])], pa.binary())],
                    names=["part", "block", "at", "hashes", "counts"])
    return run


def _totals(table: pa.Table) -> pa.Table:
    """All blocks' parts of one range to the totals of their words and the words' places in the range; a row with block -1 has
    the range's tokens and words, sums of lean x count and of lean, and by state sums of count x noise and of noise."""
    blocks, data = table.column("block").to_pylist(), table.column("hashes").to_pylist()
    hashes = [np.frombuffer(d, "<u8") for d in data]
    count = np.concatenate([_unpacked(d, "<i8") for d in table.column("counts").to_pylist()])
    known, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, weights=count, minlength=len(known)).astype(np.int64)
    at = np.append(0, np.cumsum([len(h) for h in hashes]))
    learned = total > 0
    by_state = noise(known[learned], total[learned])
    own = lean(total[learned])
    sums = [float(total.sum()), float(learned.sum()), float(own @ total[learned]), float(own.sum()), *(total[learned] @ by_state), *by_state.sum(axis=0)]
    part = table.column("part")[0].as_py()
    return pa.table({"part": pa.array([part] * (len(blocks) + 1), pa.int64()),
                     "block": pa.array([*blocks, -1], pa.int64()),
                     "at": pa.array([*table.column("at").to_pylist(), 0], pa.int64()),
                     "totals": pa.array([*[_packed(total[place[i:j]]) for i, j in zip(at, at[1:])], None], pa.binary()),
                     "places": pa.array([*[_packed(place[i:j].astype("<i4")) for i, j in zip(at, at[1:])], None], pa.binary()),
                     "sums": pa.array([None] * len(blocks) + [sums], pa.list_(pa.float64()))})


@dataclass
class Words:
    """The dictionary of a block. ``cuts``: part, place in the dictionary and number of words of each of its rows."""
    block: int
    cuts: list[tuple[int, int, int]]
    totals: np.ndarray
    places: np.ndarray
    emit: np.ndarray


def _emissions(model: Model, total: np.ndarray, hashes: np.ndarray | None, shares: np.ndarray | None, kind: str) -> np.ndarray:
    out = np.empty((len(total), STATES), kind)
    for i in range(0, len(total), WORDS_AT_ONCE):
        some = slice(i, i + WORDS_AT_ONCE)
        out[some] = (model.emissions(total[some], hashes[some], None) if shares is None else
                     model.emissions(total[some], None, _HALVES[shares[some]] * total[some].astype("f4")[:, None]))
    return out


def _read_blocks(batches: Iterator[pa.RecordBatch], model: Model, kind: str) -> Iterator[tuple[Words, Iterator[tuple]]]:
    """Blocks by their words, and their texts as they come: keys; learned, lengths and tokens. ``kind``: of the emissions."""
    def value(row: pa.RecordBatch, name: str):
        return row.column(name)[0].as_py()

    def texts_of(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for row in rows:
            learned, length, token = (_unpacked(value(row, c), k) for c, k in (("learned", "?"), ("lengths", "<i4"), ("tokens", "<i4")))
            yield row.column("keys"), learned, length.astype(np.int64), token

    rows = (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))
    for block, of_block in groupby(rows, lambda row: value(row, "block")):
        hashes, totals, places, shares, cuts = [], [], [], [], []
        for what, some in groupby(of_block, lambda row: value(row, "kind")):
            if what == TEXTS:
                total = np.concatenate(totals)
                emit = _emissions(model, total, np.concatenate(hashes) if hashes else None,
                                  np.concatenate(shares) if shares else None, kind)
                hashes, totals, shares = [], [], []
                yield Words(block, cuts, total, np.concatenate(places), emit), texts_of(some)
                continue
            for row in some:
                if what == HASHES:
                    hashes.append(np.frombuffer(value(row, "hashes"), "<u8"))
                elif what == SHARES:
                    shares.append(np.frombuffer(value(row, "data"), "<u2").reshape(-1, STATES))
                else:
                    totals.append(_unpacked(value(row, "totals"), "<i8"))
                    places.append(_unpacked(value(row, "places"), "<i4"))
                    cuts.append((value(row, "part"), value(row, "at"), len(totals[-1])))


def _slices(length: np.ndarray, most: int) -> list[tuple[slice, slice]]:
    """Sequences that lie end to end in slices of some ``most`` tokens: of the sequences and of their tokens."""
    ends = np.cumsum(length)
    number = (ends - length) // most
    first = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])[:len(length)]), len(length))
    edge = np.append(0, ends)
    return [(slice(i, j), slice(edge[i], edge[j])) for i, j in zip(first, first[1:])]


def stretches(length: np.ndarray, most: int) -> np.ndarray:
    """Lengths of texts cut into stretches of at most ``most`` tokens."""
    pieces = -(-length // most)
    out = np.full(pieces.sum(), most, np.int64)
    out[np.cumsum(pieces) - 1] = length - (pieces - 1) * most
    return out


def later(length: np.ndarray, most: int) -> np.ndarray:
    """Which of the ``stretches`` are not the first of their text."""
    pieces = -(-length // most)
    out = np.ones(pieces.sum(), bool)
    out[np.cumsum(pieces) - pieces] = False
    return out


def _expected(model: Model):
    """Expected counts of the words of each block, in parts by range; a row with part -1 per task has the starts, moves, sums and
    losses per state and log likelihood."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()),
                        ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(STATES * (STATES + 3) + 1)
        for words, rows in _read_blocks(batches, model, "f4"):
            now = hmm.Model(model.start, model.move, words.emit)
            emitted, count = np.zeros(words.emit.shape, order="F"), np.zeros(len(words.emit), np.int64)
            for _, learned, length, token in rows:
                symbol = token[np.repeat(learned, length)]
                count += np.bincount(symbol, minlength=len(count))
                pieces, goes_on = stretches(length[learned], STRETCH), later(length[learned], STRETCH)
                for some, tokens in _slices(pieces, TOKENS_AT_ONCE):
                    start, move, _, likelihood = hmm.expect(now, symbol[tokens], pieces[some], goes_on[some], model.shares(), emitted)
                    sums[:STATES] += start
                    sums[STATES:STATES * (STATES + 1)] += move.ravel()
                    sums[-1] += likelihood
            sums[-1 - 2 * STATES:-1] += np.append(emitted.sum(axis=0), lean(words.totals) @ emitted)
            for part, at, n in words.cuts:
                some = slice(at, at + n)
                shares = halves(emitted[some] / np.maximum(count[some], 1)[:, None])
                yield _row(schema, part=part, block=words.block, at=at, places=_packed(words.places[some]),
                           counts=_packed(count[some].astype("<i4")), data=shares.tobytes())
        yield _row(schema, part=-1, block=-1, at=0, data=sums.tobytes())
    return run


def _added(table: pa.Table) -> pa.Table:
    """The expected counts of one range's words over all blocks, as every block needs them; or the sums of all tasks in one row."""
    blocks, at, part = table.column("block").to_pylist(), table.column("at").to_pylist(), table.column("part")[0].as_py()
    if part < 0:
        data = [np.sum([np.frombuffer(d, "<f8") for d in table.column("data").to_pylist()], axis=0).tobytes()]
        blocks, at = [-1], [0]
    else:
        places = [_unpacked(p, "<i4") for p in table.column("places").to_pylist()]
        total = np.zeros((max(int(p.max()) for p in places) + 1, STATES))
        for p, c, d in zip(places, table.column("counts").to_pylist(), table.column("data")):
            shares = np.frombuffer(d.as_buffer(), "<u2").reshape(-1, STATES)
            total[p] += _HALVES[shares] * _unpacked(c, "<i4")[:, None].astype(float)  # a block has a word once
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
        total = halves(total)
        data = [total[p].tobytes() for p in places]
    return pa.table({"part": pa.array([part] * len(blocks), pa.int64()), "block": pa.array(blocks, pa.int64()),
                     "at": pa.array(at, pa.int64()), "data": pa.array(data, pa.binary())})


def _scored(model: Model):
    """Scores of the texts of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, rows in _read_blocks(batches, model, "f8" if model.freed is None else "f4"):
            base, known = np.log10(model.marginal(words.totals)), (words.totals > 0).astype(np.int64)
            now = hmm.Model(model.start, model.move, words.emit)
            for keys, learned, length, token in rows:
                first = np.cumsum(length) - length
                yield pa.RecordBatch.from_arrays(
                    [keys.flatten(), pa.array(~learned), pa.array(length), pa.array(np.add.reduceat(known[token], first)),
                     pa.array(np.full(len(length), model.tokens, np.int64)), pa.array(np.add.reduceat(base[token], first)),
                     pa.array(hmm.log_likelihood(now, token, length) / np.log(10))],
                    names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


@contextmanager
def _row_by_row(spark: SparkSession) -> Iterator[None]:
    """Rows are large here: they go to the workers one at a time, so that memory holds one and not all of a partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _rows_kept(df: DataFrame, folder: str) -> DataFrame:
    """Large rows, written a few at a time: by default a writer looks at what it holds once in 100 rows."""
    return kept_at(df, folder, **{"parquet.block.size": ROWS_BYTES, "parquet.page.size.row.check.min": 1,
                                  "parquet.page.size.row.check.max": 4})


def _by_block(*tables: DataFrame) -> DataFrame:
    """The rows of each block together: first what is known of its words, then its texts."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return rows.repartition("block").sortWithinPartitions("block", "kind", "at")


def _emptied(spark: SparkSession, folder: str, *tables: str) -> None:
    for table in tables:
        kept_at(spark.createDataFrame([], "block bigint"), f"{folder}/{table}")


def train(blocks: DataFrame, totals: DataFrame, model: Model, folder: str, passes: int = PASSES) -> tuple[Model, DataFrame, list[float]]:
    """The model after some passes over all blocks, the blocks with their words' totals and expected counts, and the log likelihood
    before each pass. ``blocks`` lie in ``folder``/blocks."""
    totals = totals.where("block >= 0").select("block", F.lit(TOTALS).cast("bigint").alias("kind"), "at", "part", "totals", "places")
    rows, seen = _by_block(blocks.drop("counts", "words"), totals), []
    for k in range(passes if model.tokens else 0):
        sent = _rows_kept(rows.mapInArrow(
            _expected(model), "part bigint, block bigint, at bigint, places binary, counts binary, data binary"), f"{folder}/sent")
        if not k:  # hashes were for this pass
            texts_only = blocks.where(F.col("kind") == TEXTS).drop("hashes", "counts", "words")
            blocks = _rows_kept(texts_only, f"{folder}/texts")
            _emptied(blocks.sparkSession, folder, "blocks")
        # The sums of the pass before are in what was sent: theirs is the place of the new ones.
        added = _rows_kept(sent.groupBy("part").applyInArrow(_added, "part bigint, block bigint, at bigint, data binary"),
                           f"{folder}/pass")
        sums = np.frombuffer(added.where("block < 0").first()["data"], "<f8")
        start, move, weight, freed, likelihood = np.split(sums, np.cumsum([STATES, STATES * STATES, STATES, STATES]))
        seen.append(float(likelihood[0]))
        model = Model(*hmm.next_moves(start, move.reshape(STATES, STATES)), model.tokens, model.words, weight + 1,
                      model.leaning, freed + 1)
        shares = added.where("block >= 0").select("block", F.lit(SHARES).cast("bigint").alias("kind"), "at", "data")
        rows = _by_block(blocks, totals, shares)
    return model, rows, seen


def counted_blocks(docs: DataFrame, key: str, text: str, held_out, folder: str) -> tuple[DataFrame, DataFrame, Model]:
    """Blocks, the training counts of their words by range, and the first model."""
    rows = docs.select(named(key).alias("key"), held_out.alias("held_out"), named(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    blocks = _rows_kept(rows.mapInArrow(_blocks, (
        f"block bigint, kind bigint, at bigint, keys array<{kind}>, learned binary, lengths binary, tokens binary, hashes binary, "
        "counts binary, words bigint")), f"{folder}/blocks")
    entries = blocks.agg(F.sum("words")).first()[0] or 0
    ranges = max(1, -(-entries // WORDS_PER_RANGE))
    with _row_by_row(docs.sparkSession):
        totals = _rows_kept(
            blocks.where(F.col("kind") == HASHES).select("block", "at", "hashes", "counts")
            .mapInArrow(_cut(ranges), "part bigint, block bigint, at bigint, hashes binary, counts binary")
            .groupBy("part").applyInArrow(
                _totals, "part bigint, block bigint, at bigint, totals binary, places binary, sums array<double>"), f"{folder}/totals")
    found = totals.where("block < 0").agg(*[F.sum(F.col("sums")[i]) for i in range(4 + 2 * STATES)]).first()
    tokens, words, own_tokens, own, *by_state = [x or 0.0 for x in found]
    all_counts = tokens + SMOOTH * (words + 1)
    weight = (np.array(by_state[:STATES]) + SMOOTH * np.array(by_state[STATES:]) + SMOOTH) / all_counts
    leaning = (own_tokens + SMOOTH * own + SMOOTH) / all_counts
    return blocks, totals, Model(*hmm.first_moves(STATES), int(tokens), int(words), weight, leaning)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", passes: int = PASSES,
                folder: str | None = None) -> DataFrame:
    """One row per text: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A tenth of the texts, by the checksum of the key, is held out: the model learns from the others. ``folder`` takes the tables
    written along the way; one of its own below the shared folder if none is given.
    """
    folder = folder or fresh_folder(docs.sparkSession, "hidden-markov")
    held_out = F.crc32(F.coalesce(named(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    blocks, totals, first = counted_blocks(docs, key, text, held_out, folder)
    kind = docs.schema[key].dataType.simpleString()
    with _row_by_row(docs.sparkSession):
        model, blocks, _ = train(blocks, totals, first, folder, passes)
        scored = kept_at(blocks.mapInArrow(_scored(model), (
            f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
            "score double")), f"{folder}/scores")
    return scored.withColumnRenamed("key", key)
