"""Filter audit, periodic runs and SimHash against brute force."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from waybill.llm import filter_audit, periodic_runs, simhash
from waybill.llm.catalog import QUERIES, planted
from waybill.llm.recompression import Grammar


# --- filter audit ------------------------------------------------------------------------------

def test_ranks_and_intervals_of_all_orders():
    for n in (1, 2, 4):
        every = list(itertools.permutations(range(n)))
        for rank, order in enumerate(every):
            assert filter_audit.lehmer_rank(order, n) == rank
        covered = collections.Counter(
            (mask, step, rank) for mask, step, first, behind in filter_audit.intervals(n) for rank in range(first, behind))
        for mask in range(1, 1 << n):
            for rank, order in enumerate(every):
                step = next(s for s, f in enumerate(order, 1) if mask >> f & 1)
                assert [covered[mask, s, rank] for s in range(1, n + 1)] == [int(s == step) for s in range(1, n + 1)]


def audited(rows, marks, names, fails):
    """Applies every order to every document."""
    parts = sorted({part for _, _, part in rows})
    sets = [(part, {f for f in names if fails(f, k, rows, i)}, any(q == 1 for key, q, _ in marks if key == k and k is not None),
             any(t == 1 for key, _, t in marks if key == k and k is not None)) for i, (k, _, part) in enumerate(rows)]
    out, shapley = {}, collections.Counter()
    for part in parts:
        for order in itertools.permutations(names):
            for step, f in enumerate(order, 1):
                own = [s for s in sets if s[0] == part]
                before = [s for s in own if not s[1] & set(order[:step - 1])]
                removed = [s for s in before if f in s[1]]
                shapley[part, f] += len(removed)
                out[part, "".join(order), step] = [
                    len(before) - len(removed), len(removed), sum(f in s[1] for s in own) - len(removed),
                    sum(s[1] == {f} for s in own), sum(s[2] for s in removed), sum(s[3] for s in removed)]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_as_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = ["a", "b $", "A b", "A $ x", "", None, "c c", "same", "same"]
    rows = [(int(rng.integers(0, 40)), texts[rng.integers(0, 9)], ["x", "y", None, ""][rng.integers(0, 4)]) for _ in range(120)]
    rows += [(None, "same", "x"), (None, "same", "x"), (None, None, None), (3, "same", "x"), (3, "same", "x")]
    marks = [(int(k), int(rng.integers(0, 2)), None if k % 3 else 1) for k in rng.integers(0, 50, 40)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "clash", 2.0) for r in rows],
                                 "doc_id long, text string, lang string, n int, part string, mask double")
    labels = spark.createDataFrame([(*m, 7) for m in marks], "doc_id long, quality int, toxic int, key int")
    text = F.col("text")
    filters = {"A": text.contains("A"), "B": text.contains("$"), "C": filter_audit.COPY, "D": F.length(text) > 4}
    plain = [(k, t or "", p or "") for k, t, p in rows]

    def fails(f, k, rows, i):
        t = rows[i][1]
        if f == "C":
            return k is not None and any(o is not None and o < k and t == u for o, u, _ in rows)
        return {"A": "A" in t, "B": "$" in t, "D": len(t) > 4}[f]

    found = filter_audit.audit_filters(docs, labels, filters)
    assert sorted(tuple(r) for r in found.select(*COLUMNS).collect()) == audited(plain, marks, "ABCD", fails)
    assert all(r.filter == r.filter_order[r.step - 1] for r in found.collect())
    assert filter_audit.audit_filters(docs.limit(0), labels, filters).count() == 0
    unlabelled = filter_audit.audit_filters(docs, labels.limit(0), filters).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(unlabelled) == (0, 0)


def test_audit_of_odd_documents(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    found = filter_audit.audit_filters(odd, labels)
    assert found.count() == 120 * 5 * 3  # en, fr and none
    rows = found.where("part = 'en' and filter_order = 'EDCBA'").orderBy("step").collect()
    # "same row" twice under one key is no copy; one with signs goes at D, which is the good and the toxic one.
    assert [r.removed for r in rows[:2]] == [0, 1] and (rows[1].good_lost, rows[1].toxic_lost) == (1, 1)


# --- periodic runs -----------------------------------------------------------------------------

def brute_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in out.items())


def test_grammar_extensions_as_brute_force():
    rng = np.random.default_rng(2)
    for trial in range(60):
        s = rng.integers(0, rng.integers(1, 4), rng.integers(1, 90))
        if trial % 3 == 0:
            s = np.tile(s[:1 + len(s) // 8], 11)
        a, b = rng.integers(-1, len(s) + 1, (2, 80))
        a, b = a[a != b], b[a != b]
        for back in (False, True):
            expected, move = [], -1 if back else 1
            for x, y in zip(a.tolist(), b.tolist()):
                n = 0
                while 0 <= x < len(s) and 0 <= y < len(s) and s[x] == s[y]:
                    x, y, n = x + move, y + move, n + 1
                expected.append(n)
            assert Grammar(s).extension(a, b, back).tolist() == expected


def periodic_texts():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(150):
        n = int(rng.integers(0, 90))
        words = [f"w{x}" for x in rng.integers(0, rng.integers(1, 5), n)]
        if n and rng.integers(2):
            a = int(rng.integers(0, n))
            p = 1 + (n - a) // int(rng.integers(3, 11))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        rows.append(" ".join(words))
    return rows + ["", None, " \n\t", "a " * 5, "a " * 6, "x " + "a b " * 3 + "a", "x " + "a b " * 4, "É é " * 4, "long " * 30_000]


@pytest.mark.parametrize("at_once", [200, periodic_runs.BYTES_AT_ONCE])
def test_runs_as_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(periodic_runs, "BYTES_AT_ONCE", at_once)
    rows = periodic_texts()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(rows)], "doc_id long, text string, runs string, `a.b` int")
    result = periodic_runs.periodic_runs(docs)
    assert result.columns == ["doc_id", "a.b", "runs", "collapsed"]
    for r in result.collect():
        words = (rows[r.doc_id] or "").split() if rows[r.doc_id] != rows[-1] else []
        runs = [(x.start, x.length, x.period) for x in r.runs]
        if words:
            assert runs == sorted(brute_runs(words), key=lambda x: (x[0], x[2]))
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert r.collapsed.decode() == " ".join(w for i, w in enumerate(words) if i not in gone)
    last = result.where(F.col("doc_id") == len(rows) - 1).first()
    assert [tuple(x) for x in last.runs] == [(0, 30_000, 1)] and last.collapsed == b"long"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_invalid_utf8_in_runs(spark):
    docs = spark.sql("select 1L as doc_id, cast(x'ff20ff20ff20ff20ff20ff' as string) as text")
    row = periodic_runs.periodic_runs(docs).first()
    assert [tuple(x) for x in row.runs] == [(0, 6, 1)] and row.collapsed == b"\xff"


def test_planted_periods(spark, odd):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(k, "a b c d e f g h i j k l m n o p") for k in range(100)], "doc_id long, text string"))
    seen = 0
    found = collections.Counter((r.doc_id, r.text) for r in planted(docs).collect())
    expected = collections.Counter()
    for k, t in docs.collect():
        words, h = (t or "").split() if k != 9 else [], zlib.crc32(str(k).encode())
        if k is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            t, seen = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n)), seen + 1
        expected[k, t] += 1
    assert found == expected and seen > 5


# --- SimHash -----------------------------------------------------------------------------------

def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """The smallest key of each row's component, comparing all pairs."""
    prints = [p for _, p in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 4:
            root[find(j)] = find(i)
    least = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    return sorted((str(k), f"{p:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (k, p) in enumerate(rows))


def near_texts():
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(1000 - k, " ".join(base[:k] + [f"e{k}"] + base[k + 1:])) for k in range(0, 300, 4)]
    rows += [(k, "The Same words here again and again") for k in range(3)] + [(3, "tHE same words here again and again")]
    rows += [(2000 + k, " ".join(f"r{x}" for x in rng.integers(0, 10_000, 60))) for k in range(60)]
    return rows + [(10, ""), (11, None), (12, "\n "), (None, ""), (None, "alone and without any key"), (13, "a b"), (13, "a b"), (14, "b a")]


@pytest.mark.parametrize("kept,tile", [(simhash.KEPT, simhash.TILE), (1, 5)])
def test_simhash_as_brute_force(spark, kept, tile):
    docs = spark.createDataFrame([(*r, 1, "x") for r in near_texts()], "doc_id long, text string, node int, component_id string")
    found = simhash.near_copies(docs, kept=kept, tile=tile)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found.collect()) == brute_components(
        [(k, brute_fingerprint(t)) for k, t in near_texts()])
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_simhash_query(spark, folder, documents):
    found = QUERIES["op13_simhash"](spark, folder).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == brute_components(
        [(r.doc_id, brute_fingerprint(r.text)) for r in documents.collect()])


def test_fingerprint_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 700)
    assert simhash.fingerprints([b"", text.encode(), b"x"]).tolist() == [0, brute_fingerprint(text), brute_fingerprint("x")]


@pytest.mark.parametrize("small", [200, 10])
def test_pairs_of_groups_as_brute_force(monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(small)
    for _ in range(20):
        x = rng.integers(0, 2 ** 63, 8).astype(np.uint64)[rng.integers(0, 8, 150)]
        for _ in range(4):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
        x = np.unique(x)
        group = rng.integers(0, 3, len(x))
        order = np.lexsort((simhash.distances(x, simhash.pivots())[0], group))
        x, group = x[order], group[order]
        a, b = simhash.near_pairs(group, x)
        place = {v: i for i, v in enumerate(x.tolist())}

        def components(pairs):
            root = list(range(len(x)))
            for i, j in pairs:
                root = [root[i] if r == root[j] else r for r in root]
            return {frozenset(k for k in range(len(x)) if root[k] == r) for r in set(root)}
        assert components([(place[i], place[j]) for i, j in zip(a.tolist(), b.tolist())]) == components(
            [(i, j) for i, j in itertools.combinations(range(len(x)), 2)
             if group[i] == group[j] and np.bitwise_count(x[i] ^ x[j]) <= 4])


@pytest.mark.parametrize("kept", [1, 2, 3, 4])
def test_near_fingerprints_share_a_bucket(kept):
    rng = np.random.default_rng(kept)
    masks = simhash.masks(kept)
    for _ in range(200):
        flip = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
        assert any(flip & m & (2 ** 64 - 1) == 0 for m in masks)
