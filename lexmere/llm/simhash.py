"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the XXH64
values of the text's word shingles. For radius r every bit position i gets a
vector m(i) in {0,1}^(r+1), and every non-zero v in {0,1}^(r+1) gives one table
that keeps the bits with <m(i), v> = 1. For any r positions some v is
orthogonal to all their vectors, so two fingerprints within the radius agree on
the kept bits of at least one table: no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.passages import _mix, shingle_hashes, word_hashes
from lexmere.operators.components import connected_components
from lexmere.session import small, stored

BITS = 64
#: Buckets of more fingerprints are linked in cells of about so many, each its own task unit.
CELL = 4096
#: Shingles whose bits are counted at once.
STEP = 1 << 16


def masks(radius: int) -> list[int]:
    """One 64-bit mask for each non-zero v; the pattern of m(i) walks the non-zero vectors in the step that keeps most bits in every table."""
    n = (1 << radius + 1) - 1

    def by(step: int) -> list[int]:
        m = [1 + i * step % n for i in range(BITS)]
        return [sum(1 << i for i in range(BITS) if (m[i] & v).bit_count() & 1) for v in range(1, n + 1)]

    steps = [s for s in range(1, min(n, 64) + 1) if np.gcd(s, n) == 1]
    return max(map(by, steps), key=lambda found: min(x.bit_count() for x in found))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint. Null, empty and blank texts: 0. Fewer words than a shingle: the whole sequence is one."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest, n, counts = xxhash.xxh64_digest, max(1, len(w) - shingle + 1), np.zeros(BITS, np.int64)
    for at in range(0, n, STEP):
        part = w[at : at + STEP + shingle - 1]
        if len(part) < shingle:
            got = [digest(b" ".join(part), seed)]
        else:
            got = [digest(b" ".join(s), seed) for s in zip(*(part[k:] for k in range(shingle)))]
        counts += np.unpackbits(np.frombuffer(b"".join(got), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, more: Iterable[str] = ()) -> DataFrame:
    """(id, fp) for each row, and the bigint columns named in `more`."""
    more = list(more)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["id", "fp", *more])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), *more)
    return rows.mapInArrow(of, ", ".join(f"{c} long" for c in ("id", "fp", *more)))


def _roots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first member of each element's component under the links (a, b)."""
    label = np.arange(len(x))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    while not np.array_equal(label, nxt := label[label]):
        label = nxt
    return label


def _links(x: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of x (runs are contiguous)."""
    size = np.bincount(run - run[0])[run - run[0]] if len(run) else run
    found_a, found_b = [], []
    i = np.flatnonzero(size > 1)
    for k in range(1, min(32, int(size.max(initial=1)))):
        i = i[i + k < len(x)]
        i = i[run[i] == run[i + k]]
        if not len(i):
            break
        near = i[np.bitwise_count(x[i] ^ x[i + k]) <= radius]
        found_a.append(near)
        found_b.append(near + k)
    for r in np.unique(run[size > 32]):
        at = np.flatnonzero(run == r)
        for lo in range(0, len(at), 512):
            rows = at[lo : lo + 512]
            rest = at[lo:]
            p, q = np.nonzero(np.bitwise_count(x[rows, None] ^ x[None, rest]) <= radius)
            ok = rest[q] > rows[p]
            local = _roots(x, rows[p[ok]], rest[q[ok]]) if ok.any() else np.arange(len(x))
            moved = np.flatnonzero(local != np.arange(len(x)))
            found_a.append(moved)
            found_b.append(local[moved])
    if not found_a:
        return x[:0], x[:0]
    root = _roots(x, np.concatenate(found_a), np.concatenate(found_b))
    moved = np.flatnonzero(root != np.arange(len(x)))
    return x[moved], x[root[moved]]


def _bucket_links(radius: int, most: int | None):
    """Reads rows (bucket columns..., fp) sorted by bucket; yields links (hot = 0), or the members of buckets over `most` (hot = 1)."""

    def out(t: np.ndarray, a: np.ndarray, b: np.ndarray, hot: int) -> pa.RecordBatch:
        t = np.broadcast_to(t, len(a))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot, np.int32)), pa.array(t.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["hot", "t", "a", "b"])

    def work(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        *key, x = cols
        if not len(x):
            return
        new = np.zeros(len(x), bool)
        for k in key:
            new[1:] |= k[1:] != k[:-1]
        run = np.cumsum(new)
        size = np.bincount(run)[run]
        if most is not None and (big := size > most).any():
            yield out(key[0][big], x[big], key[1][big], 1)
            run, x = run[~big], x[~big]
        a, b = _links(x.view(np.uint64), run, radius)
        if len(a):
            yield out(np.int64(0), a, b, 0)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            same = np.ones(len(cols[0]), bool)
            for c in cols[:-1]:
                same &= c == c[-1]
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held.append([c[:cut] for c in cols])
            if cut or len(held) > 1 and any(held[0][k][0] != cols[k][0] for k in range(len(cols) - 1) if len(held[0][k])):
                yield from work([np.concatenate(p) for p in zip(*held)])
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield from work([np.concatenate(p) for p in zip(*held)])

    return of


def links(fps: DataFrame, radius: int = 3, cell: int = CELL) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that join every pair within the radius, directly or through others.

    Each table's buckets are dealt by (table, kept bits) and linked inside
    their task; a bucket over `cell` goes to a second step that deals its
    members into cells, each pair of cells a bucket of its own.
    """
    kept = F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks(radius)])
    rows = fps.select("fp", F.posexplode(kept).alias("t", "k")).select("t", "k", "fp")
    schema = "hot int, t int, a long, b long"
    first = stored(rows.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(_bucket_links(radius, cell), schema))
    hot = first.where("hot = 1").selectExpr("t", "b k", "a fp")
    found = first.where("hot = 0").select("a", "b")
    if hot.isEmpty():
        return found
    cells = hot.groupBy("t", "k").agg(F.ceil(F.count("*") / cell).cast("int").alias("n"))
    own = hot.join(cells, ["t", "k"]).withColumn("c", F.expr("cast(pmod(xxhash64(fp), n) as int)"))
    dealt = own.withColumn("o", F.explode(F.expr("sequence(0, n - 1)"))).selectExpr("t", "k", "least(c, o) c", "greatest(c, o) o", "fp")
    more = dealt.repartition("t", "k", "c", "o").sortWithinPartitions("t", "k", "c", "o").mapInArrow(_bucket_links(radius, None), schema)
    return found.union(more.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, cell: int = CELL) -> DataFrame:
    """(id, fp, component): component is the least id whose fingerprint is reachable over links of at most `radius` bits.

    Equal fingerprints are joined before any table is built, so copies cost one
    row each. Null, empty and blank texts share fingerprint 0 and link like
    others. A row with a null id keeps its row; ids of components skip nulls
    (null if no member has one). Repeated rows stay repeated. Empty table:
    empty result. Other columns are not read.
    """
    f = stored(fingerprints(docs, id_col, text_col, shingle))
    fps = f.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(fps.select("fp"), radius, cell))
    of = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = stored(of)
    least = of.groupBy("root").agg(F.min("least").alias("component"))
    return f.join(of.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """docs without rows whose id is not their component's least; columns as given. Rows with a null id stay; of rows that repeat an id each text is judged on its own."""
    keyed = docs.select(id_col, text_col, F.xxhash64(F.col(text_col).cast("string")).alias("key")).where(F.col(id_col).isNotNull())
    fps = stored(fingerprints(keyed, id_col, text_col, shingle, ["key"]))
    of = near_duplicates(docs, id_col, text_col, shingle, radius).select("fp", "component").distinct()
    gone = fps.join(of, "fp").where("component < id").select("id", "key").distinct()
    return _without(docs, gone, id_col, text_col)


def _without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose id and hash of text are in gone (id, key)."""
    return docs.join(gone, (docs[id_col].cast("long") == gone["id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["key"]), "left_anti")


#: Groups of more texts are first compared with their first text alone.
BIG = 64


def _set_of(words: np.ndarray) -> np.ndarray:
    s = np.unique(shingle_hashes(words))
    return s if len(s) or not len(words) else np.array([xxhash.xxh64_intdigest(words.tobytes())], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the 5-word shingles; the words' hashes of a shorter text count as one."""
    return _set_of(word_hashes((text or "").encode("utf-8", "replace"))[0])


def sketches(words: np.ndarray, many: int) -> list[int]:
    """`many` independent signed fingerprints of the distinct ones of a text's word hashes; no words: 0."""
    own = np.unique(words)
    counts = np.zeros((many, BITS), np.int64)
    for at in range(0, len(own), STEP):
        for k in range(many):
            with np.errstate(over="ignore"):
                h = _mix(own[at : at + STEP] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
            counts[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(own), axis=1).view(">i8")[:, 0].tolist()


def _similar(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, x, y) -> (a, b) of those whose shingle sets x and y (sorted 64-bit hashes) have a Jaccard similarity of at least `least`."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for t, o in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(t.as_buffer(), np.uint64), np.frombuffer(o.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                n = np.count_nonzero(both[1:] == both[:-1])
                keep.append(n >= least * (len(both) - n))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(of, "a long, b long")


def keep_unlike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = 4, radius: int = 4, similar: float = 0.8) -> DataFrame:
    """docs without those of which an earlier kept one (a smaller id) is a copy or near copy; columns as given.

    Each text has `many` independent fingerprints over its distinct words, and
    texts of which any are within the radius are candidates: several at a small
    radius miss fewer near copies than one at a large radius that has as many
    tables. They are candidates only: a document goes if a kept one has a Jaccard
    similarity of at least `similar` over 5-word shingles, so links do not chain.
    Texts of equal shingle sets (and null, empty and blank ones) are copies. Rows
    with a null id, and repeated rows of a kept document, stay; of rows that
    repeat an id each text is judged on its own. Empty table: empty result.
    """

    def with_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingle_set(t.as_py()).tobytes() for t in part.column(5)]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sets, pa.binary())], names=["g", "node", "id", "n", "fps", "x"])

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, fps = [], [], []
            for t in b.column(2):
                w = word_hashes((t.as_py() or "").encode("utf-8", "replace"))[0]
                s = _set_of(w)
                node.append(xxhash.xxh64_intdigest(s.tobytes()))
                n.append(len(s))
                fps.append(sketches(w, many))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(fps, pa.list_(pa.int64()))], names=["id", "key", "node", "n", "fps"])

    whole = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = stored(whole.mapInArrow(of, "id long, key long, node long, n int, fps array<long>"))
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("id", "key", "fps", "n")).alias("x")).selectExpr("node", "x.*"))
    # sets of fewer shingles are similar to equal ones only
    linked = nodes.where(f"n >= {similar} * (n + 1)")
    spread = linked.select("node", F.explode_outer("fps").alias("fp"))
    met = stored(links(spread.select("fp").distinct(), radius))
    # only fingerprints that are shared or linked tie their texts together; most texts have none
    ties = met.select(F.col("a").alias("fp")).union(met.select("b")).union(spread.groupBy("fp").count().where("count > 1").select("fp")).distinct()
    tied = stored(spread.join(ties, "fp").selectExpr("node a", "fp b"))
    roots = connected_components(met.union(tied))
    grouped = linked.join(tied.selectExpr("a node").distinct(), "node").join(roots, "node", "left")
    asked = stored(grouped.select("node", "id", "key", "fps", "n", F.coalesce("root", "node").alias("g")))
    texts = whole.join(small(asked.select("id", "key")), ["id", "key"], "left_semi").groupBy("id", "key").agg(F.first("text").alias("text"))
    # each text's set is made once, not once for each pair
    left = stored(asked.join(texts, ["id", "key"]).select("g", "node", "id", "n", "fps", "text").mapInArrow(with_sets, "g long, node long, id long, n int, fps array<long>, x binary"))
    gone = nodes.select("node").limit(0)
    # the first text of a group is always kept: large groups of near copies go in a pass over the group each
    while True:
        big = left.groupBy("g").agg(F.count("*").alias("m"), F.min(F.struct("id", "node")).alias("f")).where(f"m > {BIG}").selectExpr("g", "f.node a", "m")
        lead = stored(big.join(left.select(F.col("node").alias("a"), F.col("x").alias("y"), F.col("n").alias("on")), "a").select("g", "a", "y", "on", "m"))
        tried = left.join(lead, "g").where(f"node <> a and least(n, on) >= {similar} * greatest(n, on)")
        hit = stored(_similar(tried.select("a", F.col("node").alias("b"), "x", "y"), similar))
        found, of_all = hit.count(), lead.agg(F.sum("m")).first()[0] or 0
        gone = gone.union(hit.select(F.col("b").alias("node")))
        if not of_all or not found:
            break
        left = stored(left.join(hit.select(F.col("b").alias("node")).union(lead.select("a")), "node", "left_anti"))
        if found * 50 < of_all:
            break
    tables = masks(radius)
    kept = F.flatten(F.transform("fps", lambda fp: F.array(*[fp.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in tables])))
    cells = left.select("node", "id", "n", "fps", F.posexplode_outer(kept).alias("t", "k")).withColumn("fp", F.expr(f"fps[cast(t div {len(tables)} as int)]")).drop("fps")
    near = f"(x.id < y.id or x.id = y.id and x.node < y.node) and least(x.n, y.n) >= {similar} * greatest(x.n, y.n) and bit_count(x.fp ^ y.fp) <= {radius}"
    pairs = cells.alias("x").join(cells.alias("y"), ["t", "k"]).where(near).selectExpr("x.node a", "y.node b").distinct()
    full = pairs.join(left.selectExpr("node a", "x"), "a").join(left.selectExpr("node b", "x y"), "b")
    edges = stored(_similar(full, similar))
    while not edges.isEmpty():
        sure = edges.select("a").distinct().join(edges.selectExpr("b a"), "a", "left_anti")
        out = stored(edges.join(sure, "a", "left_semi").selectExpr("b node").distinct())
        gone = gone.union(out)
        edges = stored(edges.join(out, edges.b == out.node, "left_anti").join(out, edges.a == out.node, "left_anti"))
    later = rows.join(nodes.select("node", F.col("id").alias("least")), "node").where("id > least").select("id", "key")
    drop = later.union(rows.join(gone.distinct(), "node", "left_semi").select("id", "key")).distinct()
    return _without(docs, drop, id_col, text_col)
