"""Vector codes, hard negatives and token files against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmere.llm import codes, negatives, queries, tokenfiles
from tests.test_queries import SF, con, rows  # noqa: F401

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives"])
def test_same_rows_as_sql(spark, con, name):  # noqa: F811
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# --- vector codes


def plain_codes(rows, scale=4096, parts=8, k=16, rounds=6):
    """(id -> (code, error), codebooks) in Python's whole numbers."""
    cut = lambda v: [[math.floor(scale * x) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)]
    whole = [(i, cut(v)) for i, v in sorted(rows)]
    books = [[list(w[p]) for _, w in whole[:k]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, e: min((away(e, b), i) for i, b in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, w in whole:
                own.setdefault(near(p, w[p])[1], []).append(w[p])
            for i, of in own.items():
                books[p][i] = [sum(c) // len(of) for c in zip(*of)]
    found = {}
    for i, w in whole:
        best = [near(p, w[p]) for p in range(parts)]
        found[i] = "".join(f"{b[1]:02x}" for b in best), sum(b[0] for b in best)
    return found, books


def vectors(spark, rows, kind="double", label="long"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label {label}").repartition(3)


@pytest.mark.parametrize("n,dim,spread", [(700, 16, 1.0), (300, 24, 0.001), (9, 16, 1.0), (40, 16, 0.0)])
def test_codes_as_plain(spark, n, dim, spread):
    r = random.Random(n)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    # every third vector repeats an earlier one, so there are ties and equal first entries
    made = []
    for i in range(n):
        made.append(made[r.randrange(i)] if i % 3 == 2 else [c + r.gauss(0, 1) * spread for c in r.choice(centres)])
    got, books = codes.compressed(vectors(spark, [(i, v, i % 3) for i, v in enumerate(made)]))
    want, plain = plain_codes(list(enumerate(made)))
    assert {x.id: (x.code, x.error) for x in got.collect()} == want
    assert books.tolist() == plain
    assert codes.digest(books) == hashlib.sha256(",".join(str(x) for p in plain for e in p for x in e).encode()).hexdigest()


def test_whole_nodes_are_assigned():
    """In clusters far apart nodes are assigned by their sums alone, and the result is that of plain search."""
    r = np.random.default_rng(3)
    centres = r.integers(-100_000, 100_000, (16, 8))
    points = centres[r.integers(0, 16, 4000)] + r.integers(-50, 50, (4000, 8))
    order, low, high, total = codes.PointTree.leaves(points)
    tree = codes.PointTree(points[order].astype(np.int32), low, high, total)
    sums, counts, nodes, places, code = codes.assigned(tree, codes.EntryTree(centres))
    want = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert sum(hi - lo for lo, hi, _ in nodes) > 3000 and len(places) < 1000
    assert (counts == np.bincount(want, minlength=16)).all()
    assert (sums == np.stack([points[want == i].sum(0) for i in range(16)])).all()
    got = np.zeros(4000, int)
    for lo, hi, e in nodes:
        got[order[lo:hi]] = e
    got[order[places]] = code
    assert (got == want).all()


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1), (2, [], 1), (3, [1.0] * 15 + [nan], 1), (4, [inf] * 16, 1), (5, [None] * 16, 1), (6, [1.0] * 3, 1)]
    fine = [(10, [0.5] * 16, None), (10, [0.25] * 16, None), (None, [1e300] * 16, 2), (11, [-0.0001] * 16, 2)]
    got, books = codes.compressed(vectors(spark, bad + fine).withColumn("id", F.lit("x")).withColumn("code", F.lit(1)))
    found = codes.with_label_errors(got).collect()
    assert sorted((x.id is None, x.id, x.label, x.error, x.label_error) for x in found if x.id) == [(False, 10, None, 0, 0), (False, 10, None, 0, 0), (False, 11, 2, 0, 0)]
    assert books.shape == (8, 4, 2) and books[0, :3].tolist() == [[1024, 1024], [2048, 2048], [-1, -1]] and books[0, 3, 0] == codes.limit(16)
    assert codes.compressed(vectors(spark, bad[:2]))[0].count() == 0 and codes.compressed(vectors(spark, []))[0].count() == 0
    odd, books = codes.compressed(vectors(spark, [(1, [1.0] * 5, 1), (2, [2.0] * 5, 1)]))
    assert {x.id: x.code for x in odd.collect()} == {1: "00" * 8, 2: "01" * 5 + "00" * 3} and books.shape == (8, 2, 1)


# --- hard negatives


def plain_negatives(rows, anchors, positives=5, negatives=10):
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, v, label in rows}
    out = []
    for a in anchors:
        label, c = whole[a]
        by = sorted((-sum(x * y for x, y in zip(c, d)), i, other) for i, (other, d) in whole.items() if i != a)
        for s, p, _ in [x for x in by if x[2] == label][:positives]:
            some = [x for x in by if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize("n,dim,size", [(400, 20, 1.0), (150, 8, 3000.0), (120, 3, 0.01)])
def test_negatives_as_plain(spark, n, dim, size):
    r = random.Random(dim)
    made = []
    for i in range(n):  # a third are copies of one vector, as of one hot label
        made.append((i, made[0][1] if i % 3 == 1 else [r.gauss(0.3, 1) * size for _ in range(dim)], 0 if i % 3 else r.randint(0, 4)))
    df = vectors(spark, made)
    got = negatives.hard_negatives(df, df.where("vec_id % 9 = 0")).collect()
    assert sorted(map(tuple, got)) == plain_negatives(made, range(0, n, 9))


def test_scores_are_inner_products():
    r = np.random.default_rng(1)
    for dim, most in ((64, 200), (13, 1 << 20), (1, 5), (70, 1)):
        a, c = r.integers(-most, most + 1, (9, dim)), r.integers(-most, most + 1, (1100, dim))
        planes = int(most).bit_length() + 1
        assert (negatives.scores(negatives.subset_sums(a, np.int64), negatives.packed(c, planes)) == c @ a.T).all()
    top = negatives.limit(64)
    c = negatives.whole(np.array([[1e308] * 64, [-1e308] * 64]), 256)
    assert c[0, 0] == top and int(c[0].astype(object) @ c[0].astype(object)) < 1 << 63
    assert negatives.scores(negatives.subset_sums(c, np.int64), negatives.packed(c, top.bit_length() + 1))[0].tolist() == [64 * top * top, -64 * top * top]


def test_negatives_of_odd_rows(spark):
    nan = float("nan")
    bad = [(100, None, 1), (200, [1.0, nan], 1), (300, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (400, [1.0], 1), (500, [], 1), (600, [None, 1.0], 1)]
    fine = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 9.0], 2), (2, [0.5, 9.0], 2), (3, [0.95, 1.0], 2), (4, [-1.0, 0.0], 3)]
    df = vectors(spark, bad + fine).withColumn("id", F.lit(1)).withColumn("score", F.lit(1)).withColumn("key", F.lit(1))
    got = negatives.hard_negatives(df, df.where("vec_id % 100 = 0")).collect()
    # rows that repeat an id count each for itself; 0.95 is over 90 in 100, a negative score under 30
    assert [tuple(x) for x in sorted(got)] == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 2, 65536, 32768)]
    for none in (vectors(spark, []), vectors(spark, bad[:1]), vectors(spark, fine[:1]), vectors(spark, fine[4:])):
        assert negatives.hard_negatives(none, none.where("vec_id % 100 = 0")).count() == 0


# --- token files

TEXTS = ["", None, "a", "Hola, ¿qué tal?\n\n  it's 12 ", "<|endoftext|> x<|endoftext|>", "ñandú 漢字 🙂‍↔️ ́﻿", "ab1 " * 60_000, "x" * 200_000, " " * 1_200_000 + "y", "퟿\x00  z"]


def plain_ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_as_the_library():
    t, encode = Tokenizer.from_file(BYTES), tokenfiles.encoder(BYTES)
    for text in TEXTS:
        assert encode(text or "").tolist() == plain_ids(t, text)
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["a", "B", " ", "  ", "\n", "'s", "'", "é", "1", "漢", "🙂", "_", "\t", " ", "<|endoftext|>", "́"]) for _ in range(r.randint(0, 60)))
        assert encode(text).tolist() == plain_ids(t, text), repr(text)
    # another kind of file goes through the library itself
    other = public_tokenizers.path("word_bpe_49k.json")
    assert tokenfiles.encoder(other)("Hola, mundo 12").tolist() == plain_ids(Tokenizer.from_file(other), "Hola, mundo 12")


def test_pieces():
    text = "ab cd, e " * 30_000
    assert "".join(tokenfiles.pieces(text)) == text and max(map(len, tokenfiles.pieces(text))) < tokenfiles.PIECE + 20
    for whole in ("", "x" * 300_000, ", " * 100_000):
        assert list(tokenfiles.pieces(whole)) == [whole]


def test_token_files(spark, tmp_path):
    t = Tokenizer.from_file(BYTES)
    docs = [(i * 3 - 5, x) for i, x in enumerate(TEXTS * 4)] + [(None, "no id"), (7, "again"), (7, "again"), *[(50, f"hot {i}") for i in range(400)]]
    random.Random(2).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("id", F.lit(1)).withColumn("ids", F.lit("x"))
    tokenfiles.write(df, BYTES, f"file://{tmp_path}/set", end=50256, shard=100_000)
    about = tokenfiles.manifest(f"{tmp_path}/set")
    assert about["dtype"] == "<u2" and len(about["shards"]) > 5
    got = tokenfiles.documents(spark, f"{tmp_path}/set").orderBy("start").collect()
    keys = [x.id for x in got]
    assert keys == sorted((k for k, _ in docs), key=lambda k: (k is not None, k)) and len(keys) == about["docs"]
    of = {}
    for k, text in docs:
        of.setdefault(k, []).append([*plain_ids(t, text), 50256])
    at, flat = 0, []
    for x in got:
        assert x.start == at and x.n_tokens == len(x.ids) and x.ids in of[x.id]
        of[x.id].remove(x.ids)
        at, flat = at + len(x.ids), flat + x.ids
    assert about["ids"] == at and not any(of.values())
    assert {(x.start, x.n_tokens, x.ids_crc32) for x in tokenfiles.digests(spark, f"{tmp_path}/set").collect()} == {(x.start, x.n_tokens, zlib.crc32(np.array(x.ids, "<u4").tobytes())) for x in got}
    files = tokenfiles.TokenFiles(f"{tmp_path}/set")
    assert len(files) == len(got) and [files.doc_id(i) for i in range(len(got))] == keys
    for i in (0, 1, len(got) // 2, len(got) - 1):
        assert files[i].tolist() == got[i].ids
    for start, n in ((0, 10), (at // 2, 150_000), (at - 3, 10), (at, 5)):
        assert files.window(start, n).tolist() == flat[start : start + n]
    with pytest.raises(IndexError):
        files[len(got)]


def test_token_files_of_empty_and_wide(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    tokenfiles.write(none, BYTES, f"{tmp_path}/none")
    assert tokenfiles.digests(spark, f"{tmp_path}/none").count() == 0 and len(tokenfiles.TokenFiles(f"{tmp_path}/none")) == 0
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    tokenfiles.write(one, BYTES, f"{tmp_path}/wide", end=70_000)
    assert tokenfiles.manifest(f"{tmp_path}/wide")["dtype"] == "<u4"
    assert tokenfiles.TokenFiles(f"{tmp_path}/wide")[0].tolist() == [*plain_ids(Tokenizer.from_file(BYTES), "ab"), 70_000]


def test_borders_and_shards(spark):
    first = [10, 20, 20, 20, 30]
    assert [tokenfiles.shard_of(first, k, 0) for k in (1, 15, 25, 99)] == [0, 1, 4, 5]
    assert {tokenfiles.shard_of(first, 20, r) for r in range(8)} == {1, 2, 3, 4}


def test_token_file_query(spark):
    t = Tokenizer.from_file(BYTES)
    docs = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    want, at = [], 0
    for k, text in docs:
        ids = [*plain_ids(t, text), 0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op13_token_files(spark, SF).collect())) == want
