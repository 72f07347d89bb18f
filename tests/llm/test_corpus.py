import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import connect, difference
from waybill.llm import chat, fertility, hidden_markov, hmm, mixing, near_copies, shingles, topk, urls
from waybill.llm.catalog import ORACLES, QUERIES, RULES, vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None


def test_chat_pages_and_odd_rows(spark):
    rows = [(1, i, "user" if i % 2 else "bob", f"t{i}", 0) for i in range(7)] + [
        (2, 0, "system", "alone", 0), (3, None, None, None, 0), (3, 1, "amy", "", 0), (3, 1, "amy", "", 0), (None, 0, "amy", "x", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, page int")
    found = {(r.conv_id, r.speaker, r.page): r for r in chat.rotate_perspectives(turns, 3).collect()}
    assert set(found) == ({(1, s, p) for s in ("user", "bob") for p in range(3)}
                          | {(3, "amy", 0), (3, "unknown", 0), (None, "amy", 0)})
    page = found[1, "bob", 0]
    assert [page.text[m.start:m.stop] for m in page.mask] == ["t0", "t2"] and page.n_turns == 3
    assert page.text == "<|assistant|>\nt0<|end|>\n<|user name=user|>\nt1<|end|>\n<|assistant|>\nt2<|end|>\n"
    assert found[3, "amy", 0].n_target_turns == 2
    assert chat.rotate_perspectives(turns.limit(0), 3).count() == 0


def test_urls_odd_rows(spark):
    pages = spark.createDataFrame(
        [(1, "http://WWW.Example.com/en/x?q"), (2, None), (3, "no scheme"), (4, "a://x.net"), (4, "a://x.net/fr/"),
         (5, "http://notexample.com/en/"), (6, "h://" + "a." * 2000 + "com/" + "x" * 5000)], "page_id long, url string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("com", "/", "allow")], "host string, path string, action string")
    found = sorted((r.page_id, r.path[:6], r.rule or "", r.verdict) for r in urls.filter_urls(pages, rules).collect())
    assert found == [(1, "/en/x", "www.example.com/en/", "allow"), (2, "", "", "allow"), (3, "", "", "allow"), (4, "", "", "allow"),
                     (4, "/fr/", "net/fr/", "block"), (5, "/en/", "com/", "allow"), (6, "/xxxxx", "com/", "allow")]
    assert urls.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_top_k_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0]),
            (None, [0.5, 0.0]), (50, [1e30, -1e30]), (7, [-1.0, 0.0]), (1, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(vectors, F.col("id") % 50 == 0, 3).collect()
    assert [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == 0), key=lambda r: r["rank"])] == [
        (50, 2 ** 63 - 1), (1, 32768), (1, 32768)]
    assert len([r for r in found if r.query_id == 50]) == 3
    assert topk.top_k(vectors.limit(0), F.col("id") % 50 == 0, 3).count() == 0


def test_top_k_of_repeated_query_rows(spark):
    """Tiles of queries with one content are tiles of their own: each repeated row has its whole list."""
    rows = [(0, [1.0, 0.5])] * 3072 + [(k, [k / 64, 0.0]) for k in range(1, 20)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, 5)
    lists = collections.Counter((r["rank"], r.vec_id) for r in found.collect())
    assert lists == {(rank, 20 - rank): 3072 for rank in range(1, 6)}


def test_quality_counts(documents, odd, none):
    for docs in (documents, odd):
        found = fertility.judge_quality(docs, MODEL).select(*fertility.MEASURES, "base_failed", "kept").collect()
        expected = []
        for r in docs.collect():
            text = r.text or ""
            words = [w.decode() for w in text.encode().split()]
            windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
            often, repeated = collections.Counter(windows), set()
            for i, w in enumerate(windows):
                repeated |= set(range(i, i + 5)) if often[w] > 1 else set()
            lines = [x for x in text.split("\n") if x.encode().split()]
            expected.append((len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)),
                             len(repeated)))
        assert sorted(tuple(r)[:5] for r in found) == sorted(expected)
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in found)
        assert not any(r.kept and r.base_failed for r in found)
    assert fertility.filter_quality(none, MODEL).columns == none.columns and fertility.judge_quality(none, MODEL).count() == 0


def test_quality_keeps_clean_and_drops_symbols(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels, "doc_id")
    bad = fertility.judge_quality(docs, MODEL).where("not base_failed and not kept")
    assert bad.count() == 0


def test_quality_bands_follow_the_documents(spark):
    """Most of the labelled junk goes and hardly a clean document; a language with other words has other bands."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = fertility.judge_quality(docs, MODEL).join(labels, "doc_id").where("not base_failed")
    share = {r.quality: r.share for r in found.groupBy("quality").agg(F.avg((~F.col("kept")).cast("int")).alias("share")).collect()}
    assert share[0] > 0.6 and share[1] < 0.01
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        lang, words = ("aa", 40) if i % 2 else ("bb", 400)
        rows.append((i, " ".join(f"w{k:x}" for k in rng.integers(0, words, 200)), lang))
    # As even as lang aa, labelled bb; without a language, held against the script of both.
    odd_ones = " ".join(f"w{k:x}" for k in rng.integers(0, 40, 200))
    rows += [(1000, odd_ones, "bb"), (1001, odd_ones, "aa"), (1002, odd_ones, None), (1003, odd_ones, "rare")]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wide = {name: fertility.Band((0.0, 99.0), 1.0, 0.0) for name in fertility.BANDS}
    kept = {r.doc_id: r.kept for r in fertility.judge_quality(some, MODEL, wide).collect()}
    assert [kept[k] for k in (1000, 1001, 1002, 1003)] == [False, True, True, True]
    assert {r.doc_id for r in fertility.filter_quality(some, MODEL, wide).collect()} == {k for k, v in kept.items() if v}
    assert fertility.judge_quality(some.drop("lang"), MODEL, wide).where("kept").count() > 390


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(2)
    names = np.unique(rng.integers(0, 2 ** 48, 300).astype(np.uint64))
    a, b = names[:220], names[60:280]
    x, y = rng.uniform(1, 4, len(a)), rng.uniform(1, 4, len(b))
    u, v = dict(zip(a.tolist(), x)), dict(zip(b.tolist(), y))
    exact = sum(1 / sum(max(u.get(k, 0) / u[c], v.get(k, 0) / v[c]) for k in u.keys() | v.keys()) for c in u.keys() & v.keys())
    assert shingles.similarity(a, x, b, y) == pytest.approx(exact)
    held = shingles.signatures(np.repeat([0, 1], [len(a), len(b)]), np.append(a, b), np.append(x, y), 2, 4096)
    assert (held[0] == held[1]).mean() == pytest.approx(exact, abs=0.04)


def brute_classes(rows):
    """The smallest key of each class, comparing all pairs."""
    sets = [tuple(s[1:] for s in [shingles.shingles([(t or "").encode()])])[0] for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or shingles.similarity(*sets[i], *sets[j]) >= near_copies.THRESHOLD:
                root[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return sorted((rows[i][0] or -1, min((k for k in members[find(i)] if k is not None), default=-1)) for i in range(len(rows)))


def planted(spark):
    """A hub whose copies are less like one another, a chain, exact copies, short and empty texts."""
    rng = np.random.default_rng(3)
    text = [f"w{i}" for i in range(150)]
    rows = [(100, " ".join(text))]
    for k in range(40):
        copy = list(text)
        for at in rng.choice(150, 2 + k % 3, replace=False):
            copy[at] = f"edit{k}_{at}"
        rows.append((k, " ".join(copy)))
    chain = [f"c{i}" for i in range(120)]
    for k in range(6):
        chain = chain[6:] + [f"c{k}_{i}" for i in range(6)]
        rows.append((200 + k, " ".join(chain)))
    rows += [(300, "a b c"), (301, "a b c"), (302, "a  b c"), (303, ""), (304, None), (305, "z " * 50), (305, "z " * 50),
             (None, "a b c")] + [(400 + k, " ".join(f"u{k}_{i}" for i in range(30))) for k in range(20)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_near_copies_as_brute_force(spark, documents):
    rows, docs = planted(spark)
    rows = [(k, t or "") for k, t in rows]
    found = sorted((r.doc_id or -1, -1 if r.class_id is None else r.class_id) for r in near_copies.near_copies(docs).collect())
    assert found == brute_classes(rows)
    kept = near_copies.drop_near_copies(docs)
    assert kept.count() == len({c for _, c in found}) and kept.columns == docs.columns
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_forward_and_expected_counts_by_all_paths():
    import itertools
    model = hmm.first_model(2, np.array([0.5, 0.3, 0.2]), 1)
    sequences = [[0, 1, 2, 0], [2], [1, 1, 0]]
    symbols, length = np.concatenate(sequences), np.array(list(map(len, sequences)))
    likelihood, emitted = [], np.zeros((3, 2))
    for s in sequences:
        paths = {}
        for p in itertools.product(range(2), repeat=len(s)):
            paths[p] = model.start[p[0]] * np.prod([model.emit[o, q] for o, q in zip(s, p)]) * np.prod(
                [model.move[a, b] for a, b in zip(p, p[1:])])
        total = sum(paths.values())
        likelihood.append(math.log(total))
        for p, w in paths.items():
            for o, q in zip(s, p):
                emitted[o, q] += w / total
    assert hmm.log_likelihood(model, symbols, length) == pytest.approx(likelihood)
    start, move, emit, all_ = hmm.expect(model, symbols, length)
    assert emit == pytest.approx(emitted, rel=1e-4) and all_ == pytest.approx(sum(likelihood), rel=1e-4)
    assert start.sum() == pytest.approx(3, rel=1e-4) and move.sum() == pytest.approx(5, rel=1e-4)


def test_later_stretches_are_no_starts():
    assert hidden_markov.stretches(np.array([5, 2, 4]), 2).tolist() == [2, 2, 1, 2, 2, 2]
    later = hidden_markov.later(np.array([5, 2, 4]), 2)
    assert later.tolist() == [False, True, True, False, False, True]
    model = hmm.first_model(2, np.array([0.5, 0.3, 0.2]), 1)
    symbols, shares = np.array([0, 1, 2, 0, 1, 1]), np.array([0.9, 0.1])
    start, move, emit, all_ = hmm.expect(model, symbols, np.array([2, 4]), np.array([False, True]), shares)
    alone = [hmm.expect(model, symbols[:2], np.array([2])),
             hmm.expect(hmm.Model(shares, model.move, model.emit), symbols[2:], np.array([4]))]
    assert start == pytest.approx(alone[0][0], rel=1e-4) and move == pytest.approx(alone[0][1] + alone[1][1], rel=1e-4)
    assert emit == pytest.approx(alone[0][2] + alone[1][2], rel=1e-4) and all_ == pytest.approx(alone[0][3] + alone[1][3], rel=1e-4)


def test_halves_are_the_nearest_16_bit_floats():
    every = np.arange(0x3C01, dtype="<u2").view("<f2").astype(float)  # 0 to 1
    between = (every[1:] + every[:-1]) / 2
    some = np.random.default_rng(1)
    for values in (every, between, np.nextafter(between, 0), np.nextafter(between, 1), some.uniform(0, 1, 10000), 10 ** some.uniform(-12, 0, 10000)):
        assert (hidden_markov.halves(values) == values.astype("<f2").view("<u2")).all()
    assert (hidden_markov._HALVES[hidden_markov.halves(every)] == every).all()


def test_scores(spark, folder, documents, odd, none):
    for docs in (documents, odd):
        found = hidden_markov.score_texts(docs).collect()
        tokens = [(r.doc_id, [w.decode() for w in (r.text or "").encode().lower().split()] + [" "]) for r in docs.collect()]
        held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in tokens}
        count = collections.Counter(w for k, ws in tokens if not held[k] for w in ws)
        n, v = sum(count.values()), len(count)
        expected = sorted((str(k), held[k], len(ws), sum(w in count for w in ws), n,
                           round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for k, ws in tokens)
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == expected
        assert all(math.isfinite(r.score) for r in found)
    assert hidden_markov.score_texts(none).count() == 0


def test_scores_as_baum_welch_over_all_words_at_once(spark, documents, monkeypatch):
    """Emissions of every word by itself, with blocks and ranges cut small."""
    monkeypatch.setattr(hidden_markov, "WORDS_PER_RANGE", 3000)
    docs = documents.orderBy("doc_id").limit(60)
    texts = [(r.doc_id, (r.text or "").encode().lower().split() + [b" "]) for r in docs.collect()]
    learned = [zlib.crc32(str(k).encode()) % 10 != 0 for k, _ in texts]
    number = {w: i for i, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
    hashes = shingles.word_hashes(list(number))
    symbols = [np.array([number[w] for w in ws]) for _, ws in texts]
    taught = [s for s, yes in zip(symbols, learned) if yes]
    total = np.bincount(np.concatenate(taught), minlength=len(number))
    known = total > 0
    marginal = (total + 0.1) / (total.sum() + 0.1 * (known.sum() + 1))
    emit = marginal[:, None] * hidden_markov.noise(hashes, total)
    model = hmm.Model(*hmm.first_moves(8), emit / (emit[known].sum(axis=0) + 0.1 / (total.sum() + 0.1 * (known.sum() + 1))))
    length, later = (f(np.array(list(map(len, taught))), hidden_markov.STRETCH)
                     for f in (hidden_markov.stretches, hidden_markov.later))
    shares = model.start
    for _ in range(3):
        start, move, emitted, _ = hmm.expect(model, np.concatenate(taught), length, later, shares)
        assert start.sum() == pytest.approx(len(taught), rel=1e-4)
        shares = (emitted.sum(axis=0) + 1) / (emitted.sum() + 8)
        lean = 5 / (total + 5)
        back = lean * marginal / ((lean * marginal)[known].sum() + 0.1 / (total.sum() + 0.1 * (known.sum() + 1)))
        own = (1 - lean)[:, None] * emitted
        emit = own + back[:, None] * (emitted.sum(axis=0) - own.sum(axis=0) + 1)
        model = hmm.Model(*hmm.next_moves(start, move), emit / (emitted.sum(axis=0) + 1))
        assert model.emit[known].sum(axis=0) + model.emit[~known][:1].sum(axis=0) == pytest.approx(1, rel=1e-5)
    expected = {k: hmm.log_likelihood(model, s, np.array([len(s)]))[0] / math.log(10) for (k, _), s in zip(texts, symbols)}
    found = {r.doc_id: r.score for r in hidden_markov.score_texts(docs.repartition(3), passes=3).collect()}
    assert found == pytest.approx(expected, rel=1e-4)


def test_rows_written_stay_small_however_large_a_block_is(spark, tmp_path, monkeypatch):
    """A block of 1 501 500 tokens and some 300 000 words: a row is what Spark has to hold, so it is a part of the block only. The
    same scores come out of small blocks."""
    largest, kept_at = {}, hidden_markov.kept_at

    def measured(df, folder, *some, **options):
        out = kept_at(df, folder, *some, **options)
        size = [F.coalesce(F.length(c), F.lit(0)) for c, kind in out.dtypes if kind == "binary"]
        if size:
            found = out.select(sum(size[1:], size[0]).alias("n")).agg(F.max("n")).first()[0]
            largest[folder] = max(largest.get(folder, 0), found or 0)
        return out

    docs = spark.range(1500, numPartitions=16).select(F.col("id").alias("doc_id"), F.expr(
        "array_join(transform(sequence(1, 1000), x -> cast(pmod(xxhash64(id, x), 300000) as string)), ' ')").alias("text"))
    apart = {r.doc_id: r.score for r in hidden_markov.score_texts(docs, passes=1).collect()}
    monkeypatch.setattr(hidden_markov, "kept_at", measured)
    found = hidden_markov.score_texts(docs.coalesce(1), passes=1, folder=str(tmp_path / "small")).collect()
    assert len(found) == 1500 and {r.n_tokens for r in found} == {1001}
    assert {r.doc_id: r.score for r in found} == pytest.approx(apart, rel=1e-4)
    assert len(largest) >= 4 and max(largest.values()) < 2_500_000, largest


def test_model_beats_base_on_held_out_texts(spark):
    found = hidden_markov.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    row = found.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert row.score > row.base


def test_mixing(spark, odd, none, documents):
    found = mixing.mix_sources(documents).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.source].append(r)
    sources = sorted(by)
    size = {s: sum(r.size for r in by[s]) for s in sources}
    weight, total, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        share = sum(weight[s] for s in sources if s not in capped)
        above = {s for s in sources if s not in capped and left * weight[s] / share > 3 * size[s]}
        if not above:
            break
        capped |= above
    for s in sources:
        target = 3 * size[s] if s in capped else left * weight[s] / share
        assert by[s][0].target == pytest.approx(target) and by[s][0].source_size == size[s]
        assert abs(sum(r.taken for r in by[s]) - target) <= max(r.size for r in by[s]) / 2 + 1e-6
        assert all(r.taken <= 3 * r.size for r in by[s])
    again = mixing.mix_sources(documents.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(none).count() == 0
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == mixing.mix_sources(odd).agg(F.sum("copies")).first()[0]


def test_stages_pass_all_columns_as_they_are(spark, odd):
    """Names that operators use themselves, and names that need quotes, come through with their values."""
    odd = odd.union(odd.where("doc_id = 1").withColumn("text", F.lit("one two three four five six seven eight nine ten eleven")))
    rows = {tuple(r) for r in odd.collect()}
    wide = {name: fertility.Band((0.0, 99.0), 1.0, 0.0) for name in fertility.BANDS}
    for stage in (lambda d: fertility.filter_quality(d, MODEL, wide), near_copies.drop_near_copies, mixing.mix_documents):
        found = stage(odd)
        assert found.columns == odd.columns and [f.dataType for f in found.schema] == [f.dataType for f in odd.schema]
        out = [tuple(r) for r in found.collect()]
        assert out and set(out) <= rows
    assert {r[0] for r in map(tuple, near_copies.drop_near_copies(odd).collect())} >= {1, 2, 5, 6, 7, 8, 9}


def plain_verdicts(rows):
    """What ``judge_quality`` keeps of rows (key, text, lang): every measure, quartile and band by plain loops."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = []
    for key, text, lang in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        often, repeated = collections.Counter(windows), set()
        for i, w in enumerate(windows):
            repeated |= set(range(i, i + 5)) if often[w] > 1 else set()
        ids = [i for w in words for i in pieces.encode(w)]
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in collections.Counter(ids).values())
        chars = collections.Counter()
        for w in words:
            script = next((name for code in map(ord, w) if code >= 0x250 for name, (ranges, _) in fertility.SCRIPTS.items()
                           if any(x <= code <= y for x, y in ranges)), "latin")
            chars[script] += len(w)
        script = max(("latin", "other", "cjk"), key=lambda n: chars[n])
        n, size = len(ids), sum(map(len, words))
        found.append({
            "key": key, "base": len(words) < 10 or 100 * len(repeated) > 20 * len(words), "evenness": max(entropy, 0) / math.log2(min(max(n, 2), 512)),
            "chars_per_token": size / max(n, 1), "byte_share": sum(map(pieces.is_byte, ids)) / max(n, 1), "same": (n, size, entropy),
            "groups": [None if lang is None else (lang, int(math.log2(max(1, min(n, 1024))))), None if lang is None else ("lang", lang), script]})
    measures = ("evenness", "chars_per_token", "byte_share")
    members = collections.defaultdict(dict)
    for f in found:
        if not f["base"]:
            for g in filter(None, f["groups"]):
                members[g][(tuple(f["groups"]), *f["same"], *(f[m] for m in measures))] = f

    def quartile(group, measure, p):
        values = sorted(math.floor(f[measure] * fertility.GRID + 0.5) for f in members[group].values())
        at = p * (len(values) - 1)
        low = math.floor(at)
        return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])

    def beyond(f, measure, upper):
        limits = []
        for p in (0.25, 0.75):
            value = None
            for g in reversed(f["groups"]):
                if g in members:
                    own, n = quartile(g, measure, p), len(members[g])
                    value = own if value is None else (n * own + fertility.LEAN * value) / (n + fertility.LEAN)
            limits.append(value)
        if limits[0] is None or limits[1] <= limits[0]:
            return 0
        x = f[measure] * fertility.GRID
        return max(limits[0] - x, x - limits[1] if upper else -math.inf) / (limits[1] - limits[0])

    kept = []
    for f in found:
        band = fertility.BANDS[f["groups"][2]]
        within = (band.chars_per_token[0] <= f["chars_per_token"] <= band.chars_per_token[1] and f["byte_share"] <= band.most_byte_share
                  and f["evenness"] >= band.least_evenness)
        low, other = beyond(f, "evenness", False), max(beyond(f, m, True) for m in measures[1:])
        kept.append((f["key"], not f["base"] and within and not (
            low > fertility.FENCE or low > fertility.FENCE / 2 and other > fertility.FENCE)))
    return kept


def test_verdicts_as_brute_force(spark, documents, odd):
    extra = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*documents.columns)
    for docs in (extra, odd):
        rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
        found = fertility.judge_quality(docs, MODEL).select("doc_id", "kept").collect()
        assert collections.Counter(map(tuple, found)) == collections.Counter(plain_verdicts(rows))
    assert 0 < sum(k for _, k in plain_verdicts([(r.doc_id, r.text, r.lang) for r in extra.collect()])) < extra.count()


def test_pipeline_as_brute_force(spark, folder, documents):
    """All stages one after another by plain versions; which documents are drawn is the mixing operator's own."""
    import base64
    import hashlib

    import tiktoken

    from waybill.llm.catalog import pattern
    from waybill.llm.frames import whole

    rows = {r.doc_id: r for r in documents.collect()}
    kept = [k for k, good in plain_verdicts([(r.doc_id, r.text, r.lang) for r in rows.values()]) if good]
    first = sorted({c for _, c in brute_classes([(k, rows[k].text or "") for k in kept])})
    left = documents.where(F.col("doc_id").isin(first))
    marked = left.withColumns({"a": F.xxhash64(whole(left.columns)), "b": F.xxhash64(F.lit(1), whole(left.columns))})
    copies = mixing.mix_sources(marked, identity=("a", "b")).join(marked.select("a", "b", "doc_id"), ["a", "b"]).collect()
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    expected = collections.Counter()
    for r in copies:
        text = rows[r.doc_id].text or ""
        ids = library.encode_ordinary(text)
        expected[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(text.encode()).hexdigest())] += r.copies
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, folder).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == +expected


def test_pipeline(spark, folder, documents):
    kept = corpus_pipeline.quality(spark, documents, folder)
    assert {r.doc_id for r in kept.collect()} == {
        r.doc_id for r in fertility.judge_quality(documents, MODEL).where("kept").collect()}
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near copies", "mixing", "byte-level BPE"]
