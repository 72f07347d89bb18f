import base64
import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest

from waybill.llm import byte_bpe, token_counts, token_files
from waybill.llm.catalog import QUERIES, pattern, vocabulary
from waybill.llm.transducer import Transducer, Vocabulary

MODEL, RANKS, WORDS = (vocabulary(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def library():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})


def random_texts(letters, n=60, most=300):
    rng = random.Random(5)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


TEXTS = (random_texts("etaoin shr") + random_texts("abcXYZ ,.!?éü日\n\t1234567890-=#😀")
         + ["a" * 2000, "=" * 1500, "thethe" * 300, "  ", "<s> </s>", "a \x1c b", "x\u2028 y", "don't we'll"])


@pytest.mark.parametrize("chunk", [3, 64, 1024])
def test_transducer_counts_as_the_library(pieces, chunk):
    transducer = Transducer(Vocabulary(MODEL))
    assert transducer.count([t.encode() for t in TEXTS], chunk).tolist() == [len(i) for i in pieces.encode(TEXTS)]


def test_transducer_compiles_anew_beyond_its_bound(pieces):
    transducer = Transducer(Vocabulary(MODEL))
    transducer.MOST = 1
    for part in (TEXTS[:40], TEXTS[40:]):
        assert transducer.count([t.encode() for t in part], 64).tolist() == [len(i) for i in pieces.encode(part)]


def test_op1_odd_rows(odd, none, pieces):
    found = token_counts.count_tokens(odd, MODEL, 100).collect()
    expected = sorted((str(r.doc_id), len((r.text or "").encode()), len(pieces.encode(r.text or ""))) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == expected
    assert all(r.over_limit == (r.n_tokens > 100) for r in found)
    assert token_counts.count_tokens(none, MODEL, 100).count() == 0


def test_op1_query(spark, folder, documents, pieces):
    found = {r.doc_id: r.n_tokens for r in QUERIES["op1_token_counts"](spark, folder).collect()}
    assert found == {r.doc_id: len(pieces.encode(r.text or "")) for r in documents.collect()}


def test_bpe_encodes_as_the_library_and_decodes(library):
    ids = byte_bpe.Encoder(RANKS, pattern()).encode(TEXTS)
    assert ids == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in TEXTS]
    assert byte_bpe.Decoder(RANKS).decode(ids) == [t.encode() for t in TEXTS]


def test_long_words_of_few_characters(library):
    """Windows of runs share no token; the time stays in proportion to the length."""
    rng = random.Random(8)
    texts = [c * n for c in "=-_.* aé" for n in (161, 700, 5000)] + ["=-" * 3000, "=" * 100_000, "ab" * 5000 + "=" * 999]
    texts += ["".join(rng.choice(letters) for _ in range(3000)) for letters in ("=-", "=*", "aA", "-_=", "ha")]
    encoder = byte_bpe.Encoder(RANKS, pattern())
    assert encoder.encode(texts) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    words = [t.encode() for t in texts if len(t) < 6000]
    walked = encoder._stepwise(words)
    assert [b"".join(encoder.bytes[i] for i in ids) for ids in walked] == words
    assert walked[:3] == [library._encode_single_piece(w) for w in words[:3]]


def test_op2_query(spark, folder, documents, library):
    def expected(text):
        ids = library.encode_ordinary(text)
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_byte_bpe"](spark, folder).collect()}
    assert found == {r.doc_id: expected(r.text or "") for r in documents.collect()}


def test_encode_then_decode_keeps_columns(odd, none):
    tokens = byte_bpe.encode(odd, RANKS, pattern())
    back = byte_bpe.decode(tokens, RANKS)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((r.text or "").encode() for r in odd.collect())
    assert {"doc_id", "size", "n_tokens", "decoded"} <= set(back.columns)
    assert byte_bpe.round_trip(none, RANKS, pattern()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 20000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2 ** 63, n).astype(np.uint64))
    numbers = np.arange(len(keys))
    index = token_files.Index(b"".join(token_files.Index.build(keys, keys, numbers, numbers, numbers)))
    slot, there = index.find(keys, keys)
    assert there.all() and sorted(slot.tolist()) == numbers.tolist() and (index.offset[slot] == numbers).all()
    assert not index.find(keys, keys + np.uint64(1))[1].any()


def test_index_with_equal_hashes():
    keys = np.array([5, 9, 5, 7, 5], np.uint64)
    prints, numbers = np.array([1, 2, 3, 4, 6], np.uint64), np.arange(5)
    index = token_files.Index(b"".join(token_files.Index.build(keys, prints, numbers, numbers, 10 * numbers)))
    slot, there = index.find(keys, prints)
    assert there.all() and sorted(slot.tolist()) == [0, 1, 2, 3, 4]
    assert index.shard[slot].tolist() == numbers.tolist() and index.offset[slot].tolist() == (10 * numbers).tolist()
    assert index.find(np.array([5, 9], np.uint64), np.array([2, 3], np.uint64))[1].tolist() == [False, False]


def test_invalid_utf8_becomes_replacement_characters(spark, pieces, library, tmp_path):
    docs = spark.sql("select 1L as doc_id, cast(x'61ff20c3' as string) as text")
    text = b"a\xff \xc3".decode("utf-8", "replace")
    assert token_counts.count_tokens(docs, MODEL, 9).first().n_tokens == len(pieces.encode(text))
    row = byte_bpe.round_trip(docs, RANKS, pattern()).first()
    assert row.n_tokens == len(library.encode_ordinary(text)) and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert token_files.write_token_files(docs, str(tmp_path / "files"), WORDS, 1, 2)[0].count() == 1


def test_op3_odd_rows(odd, none, tmp_path):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(WORDS)
    folder = str(tmp_path / "files")
    directory, files = token_files.write_token_files(odd, folder, WORDS, 1, 3)
    places = token_files.find(directory.select("key", "copy"), folder, files)
    read = token_files.with_start(token_files.read_ids(places, folder, 2), token_files.shard_starts(directory))
    found = sorted((r.start, r.n_tokens, str(r.key), bytes(r.ids)) for r in read.collect())
    ids = [(str(r.doc_id), np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
           for r in odd.collect()]
    assert sorted(f[2:] for f in found) == sorted(ids)
    assert [f[0] for f in found] == [0, *np.cumsum([f[1] for f in found])[:-1]]
    assert [f[2] for f in found] == ["1", "2", "3", "4", "5", "6", "7", "8", "8", "9", "None"]
    unknown = directory.select((F.col("key") + 1000).alias("key"), "copy").where("key is not null")
    assert token_files.find(unknown, folder, files).count() == 0
    assert token_files.write_token_files(none, str(tmp_path / "none"), WORDS, 1, 3)[0].count() == 0


def test_op3_query(spark, folder, documents):
    from tokenizers import Tokenizer
    tokenizer, start, expected = Tokenizer.from_file(WORDS), 0, {}
    for r in documents.orderBy("doc_id").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        expected[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_files"](spark, folder).collect()} == expected


def test_words_with_marks_are_made_of_their_parts():
    """A word with a mark at its end is remembered whole, from the ids of its parts; so are texts with unknown words."""
    words = token_files.WordTokenizer(WORDS)
    asked, encode = [], words._encode
    words._encode = lambda new: (asked.extend(new), encode(new))
    rows = [b"Foo foo. bar, bar!!", b"foo <|endoftext|>b. x<|y.", b"foo. \xff?", b""]
    found = words.encode(rows)
    assert b"foo." in words.known and b"foo." not in asked and b"bar!!" in asked
    plain = [words.tokenizer.encode(r.decode(errors="replace"), add_special_tokens=False).ids for r in rows]
    assert [list(array(words.code, f)) for f in found] == plain
    assert words.encode(rows) == found and len(asked) == len(set(asked))


def test_plain_words_go_to_the_model_alone(monkeypatch):
    """Words of letters and marks at their end skip normaliser and splitter, with the same ids; what is wanted stays known."""
    class Full:
        asked: list[str] = []

        def encode_batch_fast(self, texts, **options):
            self.asked.extend(texts)
            return words.__class__(WORDS).tokenizer.encode_batch_fast(texts, **options)

    words = token_files.WordTokenizer(WORDS)
    whole, words.tokenizer = words.tokenizer, Full()
    rows = random_texts("etaoinéßÀÿÖ abcSHR\n") + random_texts("aé.,;$%&*#!?'-1 x", 200, 30) + [
        "", "  ", "ÀÉÎ thé%%% the.*** été. it's. Ünd\x1c und", "<|endoftext|>The. İstanbul Ωσς. été¿ ×÷ " + "é" * 500, "naïve"]
    expected = [whole.encode(r, add_special_tokens=False).ids for r in rows]
    assert [list(array(words.code, f)) for f in words.encode([r.encode() for r in rows])] == expected
    assert not {"thé", "the", "naïve", "ÀÉÎ".lower(), "the.***"} & set(Full.asked) and "İstanbul" in Full.asked
    monkeypatch.setattr(token_files, "REMEMBERED", len(words.known) + 1)
    Full.asked.clear()
    assert [list(array(words.code, f)) for f in words.encode([b"it's. one two three", b""])] == [
        whole.encode("it's. one two three", add_special_tokens=False).ids, []]
    assert not Full.asked and len(words.known) < 10
