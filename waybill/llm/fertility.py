"""Quality rules: plain counts, and the fertility of a public tokenizer within bands learned from the documents.

Every word is looked up in the pieces of a vocabulary (a sentencepiece model with byte fallback). Over the words of a text:

* characters per token: broken or foreign text falls into many small pieces;
* share of byte-fallback tokens: characters that the vocabulary doesn't know;
* token entropy, as a share of what so many tokens could have at most: text that repeats few pieces is low. Beyond
  ``FULL`` tokens the possible entropy counts as that of ``FULL``, as no language spreads evenly over its pieces for ever.

A text passes if it fails neither of two rules. Limits per script (the one that holds most of its characters) are parameters and
wide. Bands come from the documents themselves: all that pass the plain rules, exact copies once, give the quartiles of each
measure per language and length (doublings of the number of tokens, as short texts are even by chance), per language, and per
script. A text is held against those of the first of these groups, each drawn towards the next wider one with the weight of ``LEAN``
documents, so that a small group leans on its language and a small language on its script. In quartile distances (Tukey's
fences) it is not kept

* if its evenness lies more than ``FENCE`` below the lower quartile, or
* if evenness lies more than half of that below, and another measure more than ``FENCE`` outside of its quartiles as well. Names,
  numbers and codes lift the other measures of clean text too, so they don't decide alone.

Quartiles hold as long as less than a quarter of a group is junk. A verdict depends on the documents it is given with.

The plain counts are exact, and so are quartiles, on a grid of 1 / ``GRID``. Only measures are moved, for the quartiles;
a worker remembers a bounded number of words.

Defined results: a NULL or empty text has no words, fails the plain rules and is not kept; texts of any length are read
whole; a NULL language, or a table without that column, leaves the script; repeated rows give a row each; an empty table gives no
rows; in ``filter_quality`` all columns pass as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from waybill.llm.arrow import as_text, kept, replaced, texts
from waybill.llm.frames import checkpointed, kept_at, named, unpacked, whole
from waybill.session import fresh_folder

BYTES_AT_ONCE = 2_000_000
REMEMBERED = 300_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
FULL = 512
#: Quartile distances beyond which a measure stands out; so many documents weigh the quartiles of the next wider group.
FENCE, LEAN = 1.5, 25
GRID = 4096


@dataclass(frozen=True)
class Band:
    """What a text may have in any case."""
    chars_per_token: tuple[float, float]
    most_byte_share: float
    least_evenness: float


#: Scripts in the order in which a word's first fitting character decides: code point ranges, band.
SCRIPTS: dict[str, tuple[tuple[tuple[int, int], ...], Band]] = {
    "cjk": (((0x2E80, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
            Band((0.25, 6.0), 0.95, 0.5)),
    "other": (((0x250, 0x1DFF), (0x2C00, 0x2DFF), (0xA000, 0xABFF), (0xD7B0, 0xF8FF), (0xFB00, 0x1FFFF)),
              Band((0.2, 9.0), 0.95, 0.5)),
    "latin": ((), Band((1.1, 12.0), 0.15, 0.66)),
}
BANDS = {name: band for name, (_, band) in SCRIPTS.items()}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _script(word: str) -> int:
    if not word.isascii():
        for code in map(ord, word):
            if code >= 0x250:
                for i, (ranges, _) in enumerate(SCRIPTS.values()):
                    if any(a <= code <= b for a, b in ranges):
                        return i
    return len(SCRIPTS) - 1


class Words:
    """Pieces of the words met so far."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = self.model.get_piece_size()
        self.byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.clear()

    def clear(self):
        self.number: dict[bytes, int] = {}
        self.chars, self.script = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
        self.n_tokens, self.tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.number))
        if len(self.number) + len(new) > REMEMBERED:
            self.clear()
            new = list(set(words))
        if new:
            decoded = [as_text(w) for w in new]
            ids = self.model.encode(decoded, num_threads=1)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.chars.append(np.fromiter(map(len, decoded), np.int64, len(new)))
            self.script.append(np.fromiter(map(_script, decoded), np.int8, len(new)))
            self.n_tokens.append(np.fromiter(map(len, ids), np.int64, len(new)))
            self.tokens.append(np.fromiter((t for i in ids for t in i), np.int32))
            for name in ("chars", "script", "n_tokens", "tokens"):
                setattr(self, name, [np.concatenate(getattr(self, name))])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def _repeated(numbers: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Words per text that lie in a window found twice or more in the text."""
    last = len(numbers) - WINDOW + 1
    if last < 1:
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = text[:last].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(WINDOW):
            key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + last]
            key ^= key >> np.uint64(31)
    inside = np.flatnonzero(text[:last] == text[WINDOW - 1:])
    order = inside[np.argsort(key[inside], kind="stable")]
    # Equal keys stand together; the words themselves decide.
    same = key[order[1:]] == key[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    equal = text[a] == text[b]
    for k in range(WINDOW):
        equal &= numbers[a + k] == numbers[b + k]
    covered = np.zeros(len(numbers) + 1, np.int64)
    for at in (np.unique(np.concatenate([a[equal], b[equal]])),):
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    return np.bincount(text[np.cumsum(covered[:-1]) > 0], minlength=n)


def measure(rows: list[bytes], words: Words, bands: dict[str, Band]) -> dict[str, np.ndarray]:
    """All counts and measures of some texts, and whether they lie within the limits of their script."""
    split = [r.split() for r in rows]
    n_words = np.fromiter(map(len, split), np.int64, len(rows))
    numbers = words.numbers([w for ws in split for w in ws])
    text = np.repeat(np.arange(len(rows)), n_words)
    out = {"n_words": n_words}

    def total(values):
        return np.bincount(text, weights=values, minlength=len(rows)).astype(np.int64)

    chars = words.chars[0][numbers]
    out["word_chars"] = total(chars)
    out["n_symbols"] = np.array([sum(r.count(s) for s in SYMBOLS) for r in rows], np.int64)
    lines = [[line for line in r.split(b"\n") if line.strip()] for r in rows]
    out["n_dup_lines"] = np.array([len(found) - len(set(found)) for found in lines], np.int64)
    out["n_repeat_words"] = _repeated(numbers, text, len(rows))
    out["base_failed"] = (n_words < 10) | (100 * out["n_repeat_words"] > 20 * n_words)

    each = words.n_tokens[0]
    starts = np.cumsum(each) - each
    n_tokens = total(each[numbers])
    length = each[numbers]
    at = np.repeat(starts[numbers] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    tokens = words.tokens[0][at]
    ends = np.cumsum(n_tokens)
    entropy, n_bytes = np.zeros(len(rows)), np.zeros(len(rows))
    for i in np.flatnonzero(n_tokens):
        own = tokens[ends[i] - n_tokens[i]:ends[i]]
        count = np.bincount(own, minlength=words.size)
        n_bytes[i] = count[words.byte].sum()
        count = count[count > 0]
        entropy[i] = np.log2(n_tokens[i]) - (count * np.log2(count)).sum() / n_tokens[i]
    some = np.maximum(n_tokens, 1)
    script = np.argmax([np.bincount(text, weights=chars * (words.script[0][numbers] == s), minlength=len(rows))
                        for s in reversed(range(len(SCRIPTS)))], axis=0)
    names = list(SCRIPTS)[::-1]
    possible = np.log2(np.clip(n_tokens, 2, FULL))
    out |= {"n_tokens": n_tokens, "chars_per_token": out["word_chars"] / some, "byte_share": n_bytes / some,
            "token_entropy": np.maximum(entropy, 0.0), "evenness": np.maximum(entropy, 0.0) / possible}
    within = np.zeros(len(rows), bool)
    for s, name in enumerate(names):
        band = bands[name]
        within |= ((script == s) & (out["chars_per_token"] >= band.chars_per_token[0])
                   & (out["chars_per_token"] <= band.chars_per_token[1])
                   & (out["byte_share"] <= band.most_byte_share) & (out["evenness"] >= band.least_evenness))
    out["script"] = np.array(names, object)[script]
    out["within"] = within
    return out


_COLUMNS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
            "n_repeat_words": "bigint", "base_failed": "boolean", "n_tokens": "bigint", "chars_per_token": "double",
            "byte_share": "double", "token_entropy": "double", "evenness": "double", "script": "string",
            "within": "boolean"}
_FOUND = ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())
#: Measures that stand out on either side; evenness does on the lower one only.
_OTHERS = ("chars_per_token", "byte_share")


def _groups(lang: Column, found: str) -> list[Column]:
    """Names of the groups of a text, the narrowest first; NULL without a language."""
    doublings = F.floor(F.log2(F.greatest(F.lit(1), F.least(F.col(f"{found}.n_tokens"), F.lit(2 * FULL)))))
    return [F.concat(F.lit("length "), doublings.cast("string"), F.lit(" "), lang), F.concat(F.lit("lang "), lang),
            F.concat(F.lit("script "), F.col(f"{found}.script"))]


def quartiles(measured: DataFrame, lang: Column, found: str) -> DataFrame:
    """Columns group, n and the quartiles of each measure in grid steps. ``found``: the struct of a text's measures."""
    names = F.array(*_groups(lang, found)).alias("groups")
    each = [F.col(f"{found}.{c}").alias(c) for c in ("evenness", *_OTHERS, "n_tokens", "word_chars", "token_entropy")]
    once = measured.where(f"not {found}.base_failed").select(names, *each).distinct()
    return (once.select(F.explode("groups").alias("group"), "evenness", *_OTHERS).where("group is not null")
            .groupBy("group").agg(F.count("*").alias("n"), *[
                F.percentile(F.round(F.col(c) * GRID).cast("bigint"), F.array(F.lit(0.25), F.lit(0.75))).alias(c)
                for c in ("evenness", *_OTHERS)]))


def _with_verdicts(measured: DataFrame, lang: Column, found: str) -> DataFrame:
    """Add ``kept``. The quartiles are written, so that Spark knows their size when it joins them."""
    bands = kept_at(quartiles(measured, lang, found), fresh_folder(measured.sparkSession, "bands"))
    out, columns = measured, measured.columns
    for k, name in enumerate(_groups(lang, found)):
        band = bands.select(F.col("group").alias(f"g{k}"), F.struct("n", "evenness", *_OTHERS).alias(f"band{k}"))
        out = out.join(band, name == F.col(f"g{k}"), "left")

    def limit(measure: str, side: int) -> Column:
        """The quartile, from the widest group to the narrowest."""
        value = None
        for k in (2, 1, 0):
            n, own = F.coalesce(F.col(f"band{k}.n"), F.lit(0)), F.col(f"band{k}.{measure}")[side]
            value = own if value is None else F.coalesce((n * own + LEAN * value) / (n + LEAN), value)
        return value

    def beyond(measure: str, upper: bool) -> Column:
        low, high, value = limit(measure, 0), limit(measure, 1), F.col(f"{found}.{measure}") * GRID
        far = F.greatest(low - value, value - high) if upper else low - value
        return F.coalesce(F.when(high > low, far / (high - low)), F.lit(0.0))

    low, other = beyond("evenness", False), F.greatest(*[beyond(c, True) for c in _OTHERS])
    outside = (low > FENCE) | ((low > FENCE / 2) & (other > FENCE))
    return out.select(*columns, (F.col(f"{found}.within") & ~F.col(f"{found}.base_failed") & ~outside).alias("kept"))


def _lang(docs: DataFrame, lang: str) -> Column:
    return (named(lang) if lang in docs.columns else F.lit(None)).cast("string")


def judge_quality(docs: DataFrame, model: str, bands: dict[str, Band] = BANDS, key: str = "doc_id",
                  text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: the key, the counts, ``base_failed``, the measures and ``kept``."""
    rows = docs.select(named(key).alias("key"), _lang(docs, lang).alias("lang"), named(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in texts(batches, BYTES_AT_ONCE):
            found = measure(some, kept(Words, model), bands)
            yield replaced(batch, ["key", "lang"], found=_struct(found))

    kind = rows.schema["key"].dataType.simpleString()
    measured = checkpointed(rows.mapInArrow(run, f"key {kind}, lang string, found struct<{_FOUND}>"))
    return _with_verdicts(measured, F.col("lang"), "found").select(
        F.col("key").alias(key), *[f"found.{c}" for c in _COLUMNS if c != "within"], "kept")


def _struct(found: dict[str, np.ndarray]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(found[c]) for c in _COLUMNS], names=list(_COLUMNS))


def filter_quality(docs: DataFrame, model: str, bands: dict[str, Band] = BANDS, text: str = "text",
                   lang: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns. Those that pass the plain rules are written once with their
    measures, as the bands are known only then."""
    columns = docs.columns
    rows = docs.select(whole(columns), _lang(docs, lang).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in texts(batches, BYTES_AT_ONCE, text, "row"):
            measures = measure(some, kept(Words, model), bands)
            yield replaced(batch, ["row", "lang"], found=_struct(measures)).filter(pa.array(~measures["base_failed"]))

    schema = StructType([*rows.schema.fields, StructField("found", DataType.fromDDL(f"struct<{_FOUND}>"))])
    folder = fresh_folder(docs.sparkSession, "measured")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    measured = docs.sparkSession.read.parquet(folder)
    return _with_verdicts(measured, F.col("lang"), "found").where("kept").select(*unpacked(columns))
