"""Nearest neighbours, near-duplicates, passages and decontamination against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmere.llm import ann, decontaminate, passages, queries, simhash
from lexmere.session import stored, table

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, id long, t string, component string"


def docs_of(spark, rows):
    """Documents with more columns, whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, -1, "x", "y") for i, t in rows], DOCS)


# --- nearest neighbours


def nearest_plain(rows, asked, k=10):
    out = {}
    for q, v in asked:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = d[:k]
    return out


def test_nearest_query_recall_and_scores(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, np.asarray(r.embedding, np.float64)) for r in e]
    want = nearest_plain(rows, [(i, v) for i, v in rows if i % 100 == 0])
    got = {}
    for r in queries.op1_nearest(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    exact = {(q, i): d for q in want for d, i in nearest_plain(rows, [(q, dict(rows)[q])], len(rows))[q]}
    assert all(s == pytest.approx(exact[q, i], abs=1e-12) for q in got for s, i in got[q])


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0, 2.0]), (None, [1.0, 1.0]), (9, [0.0, 2.0]), (9, [0.0, 2.0]), (100, [1.0, 0.0]), (200, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x")).withColumn("ids", F.lit(1))
    got = [(r.query_id, r["rank"], r.id) for r in ann.nearest(v, v.where("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    few = ann.nearest(v, v.where("vec_id = 0"), k=50)
    assert [r.id for r in few.orderBy("rank").collect()] == [1, 2, 100, 9]
    assert ann.nearest(v.limit(0), v).count() == 0 and ann.nearest(v, v.limit(0)).count() == 0


def test_nearest_many_blocks(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=24)]) for i in range(900)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for x in ann.nearest(v, v.where("vec_id % 50 = 0"), k=5, per_list=64, per_tile=100).collect():
        got.setdefault(x.query_id, set()).add(x.id)
    want = nearest_plain(rows, [x for x in rows if x[0] % 50 == 0], 5)
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("huge", [1e30, 1e160, 1e308])
def test_nearest_with_huge_finite_components(spark, huge):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=16)]) for i in range(400)]
    rows[7] = (7, [huge] * 16)
    rows[100] = (100, [huge, -huge] * 8)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for x in ann.nearest(v, v.where("vec_id % 100 = 0"), k=5).collect():
        got.setdefault(x.query_id, {})[x.id] = x.score
    for q in (0, 200, 300):
        want = dict((i, d) for d, i in nearest_plain([x for x in rows if x[0] not in (7, 100)], [rows[q]], 5)[q])
        assert got[q] == pytest.approx(want, rel=1e-12)
    assert len(got[100]) == 5


def test_inner_products_from_packed_bits():
    r = np.random.default_rng(3)
    for dim in (8, 24, 64, 100):
        unit = r.normal(size=(5, dim))
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        words, _, own = ann.encode(r.normal(size=(50, dim)), np.eye(dim))
        of, least, step = ann.planes(unit)
        signs = np.unpackbits(words.view(np.uint8), axis=1)[:, :dim] * 2.0 - 1
        inner = 2 * step[:, None] * ann.common(of, words) + 2 * least[:, None] * (signs > 0).sum(1) - unit.sum(1)[:, None]
        assert np.abs(inner - unit @ signs.T).max() < 0.1 * np.sqrt(dim) and np.all((own > 0) & (own <= 1))


def test_nearest_repeated_ids_keep_their_own_codes(spark):
    r = np.random.default_rng(4)
    rows = [(i % 150, [float(x) for x in r.normal(size=12)]) for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = {(x.query_id, x["rank"]): x.id for x in ann.nearest(v, v.where("vec_id = 100").limit(1), k=150).collect()}
    assert len(set(got.values())) == len(got) == 149


# --- near-duplicates


def fingerprint_plain(text, n=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_plain(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= radius and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 6])
def test_masks_cover(radius):
    found = simhash.masks(radius)
    r = random.Random(radius)
    assert len(found) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        differ = sum(1 << b for b in r.sample(range(64), r.randint(0, radius)))
        assert any(m & differ == 0 for m in found)


def test_fingerprints_are_sparks_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a é b"))).first()[0] % (1 << 64) == fingerprint_plain("a é b")


def test_near_duplicates_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: fingerprint_plain(t) for i, t in text.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, SF).collect()}
    want = components_plain(fps, 3)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in text}


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(70_000))
    rows = [(5, None), (4, ""), (9, " \n"), (7, "A b"), (8, "a\tB "), (3, "a b c"), (None, "a b c"), (3, "a b c"), (11, long), (12, long.upper())]
    got = sorted((r.id if r.id is not None else -1, r.component) for r in simhash.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (4, 4), (5, 4), (7, 7), (8, 7), (9, 4), (11, 11), (12, 11)]
    assert next(r.fp for r in simhash.near_duplicates(docs_of(spark, [(1, long)])).collect()) % (1 << 64) == fingerprint_plain(long)
    kept = simhash.keep_one(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "id", "t", "component"]
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 3, 3, 4, 7, 11]
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_large_buckets_in_cells(spark):
    r = random.Random(4)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(400)} | {r.getrandbits(64) for _ in range(100)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = [(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.links(spark.createDataFrame(signed, "fp long"), 3, cell=16).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in edges) and len(edges) < 15 * 500 * 30
    want = components_plain(dict.fromkeys(fps) | {f: f for f in fps}, 3)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert want[a] == want[b]
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {f: find(f) for f in fps} == want


@pytest.mark.parametrize("big", [2, 64])
def test_near_duplicates_are_checked_on_the_texts(spark, monkeypatch, big):
    monkeypatch.setattr(simhash, "BIG", big)
    rng = random.Random(8)
    rows = []
    for _ in range(8):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for edits in (0, 1, 2, 3, 4, 6, 8, 0):
            t = base[:]
            for i in rng.sample(range(120), edits):
                t[i] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    rows += [(900, "a b c"), (901, "a b d"), (902, "A  b c"), (903, None), (904, " "), (0, "another text of an id that is there already")]
    kept = {(x.doc_id, x.text) for x in simhash.keep_unlike(docs_of(spark, rows)).collect()}
    like = lambda x, y: len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y)))
    sets = [(i, t, simhash.shingle_set(t)) for i, t in rows]
    for i, t, s in sets:
        if (i, t) not in kept:  # nothing is lost without a kept near copy
            assert any(j < i and (j, u) in kept and (like(s, v) >= 0.8 or not len(s) and not len(v)) for j, u, v in sets), (i, t)
    both = [(i, j) for i, t, s in sets for j, u, v in sets if i < j and (i, t) in kept and (j, u) in kept and like(s, v) >= 0.9]
    assert not both and (902, "A  b c") not in kept and {(901, "a b d"), rows[-1]} <= kept


def near_plain(rows, least=0.8):
    """Ids that go when each text in order of id goes if a kept one before it is as similar: candidates by an inverted index over the rarest shingles."""
    sets = {i: simhash.shingle_set(t) for i, t in sorted(rows)}
    count = Counter(h for s in sets.values() for h in s.tolist())
    index, gone = {}, set()
    for i, s in sets.items():
        keys = sorted(s.tolist(), key=lambda h: (count[h], h))[: len(s) - math.ceil(least * len(s)) + 1] or [None]
        for j in sorted({j for h in keys for j in index.get(h, ())}):
            both = len(np.intersect1d(s, sets[j], assume_unique=True))
            if j not in gone and (both >= least * (len(s) + len(sets[j]) - both)):
                gone.add(i)
                break
        for h in keys:
            index.setdefault(h, []).append(i)
    return gone


def test_near_copies_that_the_stage_drops(spark):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text or "") for r in table(spark, SF2, "documents").collect()]
    long = [t.split() for _, t in rows if 40 <= len(t.split()) < 2000]
    for n in range(300):
        words = list(rng.choice(long))
        for _ in range(max(1, int(len(words) * rng.uniform(0.005, 0.03)))):
            at, other = rng.randrange(len(words)), rng.choice(rng.choice(long))
            words[at : at + rng.randint(0, 1)] = [other] if rng.random() < 0.8 else []
        rows.append((10**6 + n, " ".join(words)))
    want = near_plain(rows)
    gone = {i for i, _ in rows} - {r.doc_id for r in simhash.keep_unlike(docs_of(spark, rows)).collect()}
    copies = {i for i, t in rows if i < 10**6} & want
    planted = {i for i in want if i >= 10**6}
    assert len(planted) > 200 and len(planted & gone) >= 0.95 * len(planted)
    assert len(copies & gone) >= 0.95 * len(copies)
    # a text that stays by a miss can take others with it, no other may go
    assert len(gone - want) <= len(want - gone)


# --- passages


def test_compact_windows():
    r = np.random.default_rng(0)
    for least, high in ((5, 50), (46, 6), (10, 10**6)):
        parts = [r.integers(0, high, n).astype(np.uint64) for n in (0, 30, 120, 3, 77)]
        n = np.array([len(p) for p in parts])
        end = np.cumsum(n)
        begin, flat = end - n, np.concatenate(parts)
        _, left, c, right = passages.compact_windows(flat, begin, end, least, np.uint64(5))
        key = [(int(x) >> 22, i) for i, x in enumerate(passages._mix(flat ^ np.uint64(5)))]
        want = set()
        for s, t in zip(begin.tolist(), end.tolist()):
            for i in range(s, t):
                lo = hi = i
                while lo > s and key[lo - 1] > key[i]:
                    lo -= 1
                while hi < t - 1 and key[hi + 1] > key[i]:
                    hi += 1
                if hi - lo + 1 >= least:
                    want.add((lo, i, hi))
        assert set(zip(left.tolist(), c.tolist(), right.tolist())) == want


def test_texts_are_hashed_together_as_alone(monkeypatch):
    texts = ["", "a", " ", "a b c d e", "f g h i j k", " lead and trail of five words ", "É ü ß " * 40, "word" * 300, "x y z"] * 5
    alone = [passages.shingle_hashes(passages.word_hashes(t.encode())[0]) for t in texts]
    for together in (1, 50, 1 << 18):
        monkeypatch.setattr(passages, "TOGETHER", together)
        passages._kept_powers.cache_clear()
        for column, wanted in ((pa.array(texts), alone), (pa.array(texts, pa.large_string())[3:20], alone[3:20]), (pa.array([], pa.string()), [])):
            found = list(passages.shingles_of(column))
            assert len(found) == len(wanted)
            assert all(np.array_equal(x, y) for x, y in zip(found, wanted))
    passages._kept_powers.cache_clear()


def test_passages_query_finds_all_exact_repeats(spark):
    words = {r.doc_id: r.text.encode().lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first, need = {}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            f = first.setdefault(tuple(words[i][k : k + 50]), i)
            if f != i:
                need.setdefault(i, set()).update(range(k, k + 50))
    got, similar = {}, []
    for r in queries.op9_passages(spark, SF).collect():
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word + 1))
        similar.append(r.similarity)
        assert r.other_id < r.doc_id and r.last_word - r.first_word >= 49
    assert need and all(w <= got.get(i, set()) for i, w in need.items())
    assert min(similar) >= 0.8


def test_passages_near_and_clean(spark):
    r = random.Random(3)
    make = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    shared = make(80)
    near = list(shared)
    near[40] = "other"
    rows = [(1, " ".join(make(100) + shared + make(50))), (2, " ".join(make(30) + near + make(60))), (3, " ".join(make(300))), (4, " ".join(shared[:49])), (5, None), (6, ""), (None, " ".join(shared)), (7, " ".join(shared)), (7, " ".join(shared))]
    found = {(x.doc_id, x.other_id): x for x in passages.duplicate_passages(docs_of(spark, rows)).collect()}
    assert set(found) == {(2, 1), (7, 1)}
    assert (found[2, 1].first_word, found[2, 1].last_word, found[2, 1].other_first, found[2, 1].other_last) == (30, 109, 100, 179)
    kept = passages.cut(docs_of(spark, rows))
    text = {x.doc_id: x.text for x in kept.collect()}
    assert kept.columns == ["doc_id", "text", "id", "t", "component"] and set(text) == {1, 2, 3, 4, 5, 6, None}
    assert text[2].split() == rows[1][1].split()[:30] + rows[1][1].split()[110:] and text[1] == rows[0][1]
    assert passages.duplicate_passages(docs_of(spark, rows).limit(0)).count() == 0


def _fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_passages_built_on_a_frequent_line(spark):
    rng = random.Random(3)
    rows, want = [], 40
    for k in range(want):
        line = _fresh(rng, 40)
        passage = _fresh(rng, 5) + line + _fresh(rng, 5)
        # the earliest text has the line only, the others the passage, the last of them late
        for j, middle in enumerate((line, passage, _fresh(rng, 300) + passage)):
            rows.append((10 * k + j, " ".join(_fresh(rng, 70) + middle + _fresh(rng, 70))))
    found = {(x.doc_id, x.other_id) for x in passages.duplicate_passages(docs_of(spark, rows)).collect()}
    assert {(10 * k + 2, 10 * k + 1) for k in range(want)} <= found


def test_near_passages_behind_an_earlier_fragment(spark):
    """A passage of 100 words, two of them changed in the later text, of which an earlier text has 35 words."""
    rng = random.Random(11)
    rows, want = [], 100
    for k in range(want):
        passage = _fresh(rng, 100)
        near = list(passage)
        for at in rng.sample(range(100), 2):
            near[at] = _fresh(rng, 1)[0]
        for j, middle in enumerate((passage[30:65], passage, near)):
            rows.append((10 * k + j, " ".join(_fresh(rng, 60) + middle + _fresh(rng, 60))))
    found = {(x.doc_id, x.other_id) for x in passages.duplicate_passages(docs_of(spark, rows)).collect()}
    assert sum((10 * k + 2, 10 * k + 1) in found for k in range(want)) >= 0.95 * want
    assert all(a // 10 == b // 10 and a % 10 == 2 for a, b in found)


def test_open_windows_of_large_groups_meet_all_earlier_ones(spark, monkeypatch):
    """A group of 20 windows, of which 15 is covered, and one of 5, which again() joins in all pairs; blocks of 3 lose nothing."""
    monkeypatch.setattr(passages, "BLOCK", 3)
    both = spark.createDataFrame([(8, 9, i, 100 + i, i, i + 20, i + 80, True) for i in range(20)] + [(4, 5, i, 100 + i, 0, 20, 80, True) for i in range(5)], "a long, b long, doc long, key long, l int, c int, r int, open boolean")
    spans = spark.createDataFrame([(15, 115, [(0, 500)])], "doc long, key long, spans array<struct<first_word:int,last_word:int>>")
    got = [(x.sig, x.doc, x.other, x.l, x.ol) for x in passages.rest(both, spans).collect()]
    assert sorted(got) == [(sig, i, k, i, k) for sig in (8, 9) for i in range(20) if i != 15 for k in range(i)]
    assert passages.rest(both.where("a = 4"), spans) is None
    assert passages.rest(both.where("doc = 15"), spans) is None


def test_rest_leaves_out_texts_that_share_a_line_only(spark):
    """Of 20 texts with one frequent line, two have a passage of 70 words around it; a span that covers it leaves none."""
    rng = random.Random(21)
    line, around = _fresh(rng, 30), [_fresh(rng, 20) for _ in range(2)]
    words = [_fresh(rng, 40) + line + _fresh(rng, 40) for _ in range(20)]
    for i in (7, 12):
        words[i][20:90] = around[0] + line + around[1]
    texts = spark.createDataFrame([(i, 100 + i, " ".join(w)) for i, w in enumerate(words)], "doc long, key long, text string")
    both = spark.createDataFrame([(8, 9, i, 100 + i, 20, 45, 80, True) for i in range(20)], "a long, b long, doc long, key long, l int, c int, r int, open boolean")
    spans = lambda doc: spark.createDataFrame([(doc, 100 + doc, [(20, 89)])], "doc long, key long, spans array<struct<first_word:int,last_word:int>>")
    assert sorted((x.sig, x.doc, x.other, x.l, x.r, x.ol, x.orr) for x in passages.rest(both, spans(3), texts=texts).collect()) == [(sig, 12, 7, 20, 80, 20, 80) for sig in (8, 9)]
    assert passages.rest(both, spans(3)).count() == 2 * 187  # the windows of 3 are covered
    assert {x.doc for x in passages.rest(both.withColumn("r", F.lit(100)), spans(12), texts=texts).collect()} == set()


def test_open_texts_meet_few_others(spark):
    """Of 40 texts with one frequent line 35 have a passage of 70 words around it: each later one meets one or a few of these, not all; the first text that has a rare shingle is met before."""
    rng = random.Random(22)
    line, around = _fresh(rng, 30), [_fresh(rng, 20) for _ in range(2)]
    words = [_fresh(rng, 40) + line + _fresh(rng, 40) for _ in range(40)]
    for i in range(5, 40):
        words[i][20:90] = around[0] + line + around[1]
    texts = spark.createDataFrame([(i, 100 + i, " ".join(w)) for i, w in enumerate(words)], "doc long, key long, text string")
    both = spark.createDataFrame([(8, 9, i, 100 + i, 20, 45, 80, True) for i in range(40)], "a long, b long, doc long, key long, l int, c int, r int, open boolean")
    spans = spark.createDataFrame([], "doc long, key long, spans array<struct<first_word:int,last_word:int>>")
    got = [(x.doc, x.other) for x in passages.rest(both, spans, texts=texts).collect()]
    assert {d for d, _ in got} == set(range(6, 40)) and all(o >= 5 for _, o in got)
    assert len(got) <= 2 * 34 * passages.BLOCKS  # 2 * 595 pairs have the passage
    later, earlier = passages.opened(both, spans)
    known = passages.shared(later, passages.hashed(texts, earlier))
    met = passages.firsts(known).collect()
    assert sorted((x.sig, x.doc, x.other) for x in met) == [(sig, i, 5) for sig in (0, 1) for i in range(6, 40)]
    assert all(x.l == x.ol and x.r == x.orr and x.l <= 22 and x.r >= 83 for x in met)
    covered = known.withColumn("spans", F.expr("array(named_struct('first_word', 20, 'last_word', 89))"))
    assert passages.hopeful(known).count() == 34
    assert passages.hopeful(covered).count() == 0 and passages.firsts(covered).count() == 0


def test_joined_spans():
    """Spans of shingles whose words touch are one; words between them keep them apart."""
    assert passages._joined([(50, 80), (0, 45), (86, 90), (60, 70)]) == [(0, 80), (86, 90)]


def test_no_passage_is_excluded():
    """Texts with lines, runs of one word and edits: where verified() finds a passage that no span holds, _hopeful() is true."""
    rng, found, excluded = np.random.default_rng(5), 0, 0
    lines = [rng.integers(0, 10**9, n) for n in (15, 25, 35, 45, 60, 90)] + [np.full(n, n) for n in (30, 80)]

    def text():
        parts = [lines[k].copy() for k in rng.integers(0, len(lines), 4)] + [rng.integers(0, 10**9, 20)]
        out = np.concatenate([parts[k] for k in rng.permutation(5)])
        edit = rng.random(len(out)) < rng.choice([0, 0.01, 0.03])
        out[edit] = rng.integers(0, 10**9, edit.sum())
        return passages.shingle_hashes(out.astype(np.uint64))

    for _ in range(400):
        a, others = text(), [text() for _ in range(3)]
        codes, x = np.unique(a, return_inverse=True)
        of, at = zip(*((c, i) for i, b in enumerate(others) for c in np.flatnonzero(np.isin(codes, b)))) if any(np.isin(a, b).any() for b in others) else ((), ())
        lo = int(rng.integers(0, len(a)))
        spans = [(lo, lo + int(rng.integers(40, 90)))]
        good = passages._hopeful(x, np.ones(len(a), bool), spans, np.array(of, int), np.array(at, int), 3, 46, 0.8)
        for b, g in zip(others, good):
            new = [p for p in passages.verified(a, b, 50, 0.8) if not (spans[0][0] <= p[0] and p[1] <= spans[0][1])]
            assert g or not new
            found, excluded = found + bool(new), excluded + (not g)
    assert found > 200 and excluded > 200


def test_passages_of_repeated_ids_and_clashing_names(spark):
    rng = random.Random(12)
    shared, other = _fresh(rng, 80), _fresh(rng, 200)
    rows = [(1, " ".join(shared)), (2, " ".join(["a", *shared])), (2, " ".join(other)), (3, " ".join(other)), (3, " ".join(other)), (4, " ".join(_fresh(rng, 20) + other[:90]))]
    docs = docs_of(spark, rows).withColumns({"_cut": F.lit(1), "_doc": F.lit(2), "_key": F.lit("k"), "DOC": F.lit(5), "key": F.lit(6)})
    kept = passages.cut(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == [(1, rows[0][1]), (2, "a "), (2, rows[2][1]), (4, " ".join(rows[5][1].split()[:20]) + " ")]


def test_hot_windows_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(passages, "PROBE", 1)
    rng = random.Random(13)
    shared = _fresh(rng, 70)
    docs = docs_of(spark, [(i, " ".join(_fresh(rng, 30) + shared + _fresh(rng, 30))) for i in range(120)]).repartition(6)
    assert {(x.doc_id, x.other_id, x.first_word, x.last_word) for x in passages.duplicate_passages(docs).collect()} == {(i, 0, 30, 99) for i in range(1, 120)}


def test_passages_with_failed_partial_joins():
    rng = np.random.default_rng(5)
    word = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64)
    of = passages.shingle_hashes
    a = word(90)
    longer = np.concatenate([a[:45], word(10), a[45:]])
    (one,) = passages.verified(of(longer), of(a), 50, 0.8)
    assert one[:2] == (0, 95)
    b = word(95)
    edited = b.copy()
    edited[[20, 45]] = word(2)
    (one,) = passages.verified(of(edited), of(b), 50, 0.8)
    assert one[:2] == (0, 90)


def test_passages_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(passages, "GROUP", 400)
    monkeypatch.setattr(passages, "OVERLAP", 150)
    r = np.random.default_rng(2)
    flat = r.integers(0, 1 << 60, 2000).astype(np.uint64)
    spans = [(o, flat[o : o + passages.GROUP]) for o in range(0, len(flat) - passages.OVERLAP, passages.GROUP - passages.OVERLAP)]
    assert all(any(o <= i and i + 46 <= o + len(p) for o, p in spans) for i in range(2000 - 46))


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def contamination_plain(docs, items, length=10):
    wins = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - length + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + length]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, named = WORD.findall((t or "").translate(LOW)), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if (s := wins.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    named |= s
        named.discard(None)
        out[d] = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op4_decontamination(spark, SF).collect()}
    assert got == contamination_plain(docs, items)


def test_decontamination_odd_rows(spark):
    docs = [(1, "a b c d e f g h i j k l m n o"), (2, "x the y"), (3, None), (4, ""), (5, "A,B.C d e f g h i j k"), (6, "the the the"), (7, "a " * 5000), (8, "Été été\x00é1")]
    items = [(1, "a b c d e f g h i j k"), (2, "the"), (3, "the the"), (4, None), (5, "!!"), (6, "a " * 12), (7, "c d e f g h i j k l m"), (1, "y"), (9, "zz top"), (10, "été é1"), (None, "x"), (2, "the")]
    d, b = docs_of(spark, docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, wid int")
    got = {r.doc: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(d, b).collect()}
    assert got == contamination_plain(docs, items)
    twice = decontaminate.contamination(d.unionByName(d).unionByName(docs_of(spark, [(2, "nothing here"), (None, "the")])), b).collect()
    assert len(twice) == 18 and sorted(r.contaminated for r in twice if r.doc == 2) == [False, True, True] and [r.contaminated for r in twice if r.doc is None] == [True]
    clean = decontaminate.clean(d, b)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, x in contamination_plain(docs, items).items() if not x[4]}
    assert decontaminate.contamination(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    d = docs_of(spark, [(1, "a b c d e f g"), (2, "a b c x x x x e g")])
    wins = spark.createDataFrame([("c e g".split(),)], "win array<string>").selectExpr("1L wid", "win")
    terms = stored(decontaminate.terms_of(wins, True))
    postings = decontaminate.index(d, terms.select("term").distinct())
    near = lambda slack: sorted({r.doc for r in decontaminate.proximity_matches(postings, terms, slack).collect()})
    assert near(0) == [] and near(2) == [1] and near(6) == [1, 2]
