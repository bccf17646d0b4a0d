"""Hard negatives by exact integer inner products, scored with the method of the Four Russians.

Components become whole numbers. Eight dimensions make a group. For an anchor
and a group, the sums of all 256 subsets of its eight components are tabled
once; a candidate's components are kept as bit planes, each group's eight bits
of a plane in one byte. The inner product with the candidate is then, from the
sign plane down, twice what there is so far plus the tables' entries at the
plane's bytes: lookups, shifts and additions, and no multiplication.

Candidates are dealt to tiles of bounded size by a hash of the row, so no label
or copy gathers anywhere. A tile's packed planes are held by one task, past
which all anchors stream in blocks; each brings back a few rows a tile. A first
pass finds each anchor's positives, a second its negatives within bounds that
the positives' scores set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmere.session import stored

#: Rows in a tile at most; anchors that are scored at once; candidates between two looks at the tables.
TILE, ANCHORS, ROWS = 1 << 16, 128, 512


def usable(vector: Column) -> Column:
    """True for vectors whose components are all there and finite; false for null and empty ones."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def limit(dim: int) -> int:
    """The greatest magnitude of a component whose inner products of that size all fit 63 bits."""
    return (1 << (62 - (dim - 1).bit_length()) // 2) - 1


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held within +-limit."""
    most = limit(x.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * scale), -most, most).astype(np.int64)


def packed(c: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of whole numbers as bytes [row, plane, group of eight dimensions]; the last plane is the sign's (two's complement)."""
    bits = c[:, None, :] >> np.arange(planes)[None, :, None] & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """[group, subset, anchor]: sums of each subset of eight components, bit i of the subset for component i of the group."""
    n, dim = anchors.shape
    groups = -(-dim // 8)
    wide = np.zeros((n, groups * 8), dtype)
    wide[:, :dim] = anchors
    by = wide.reshape(n, groups, 8).transpose(1, 2, 0)
    table = np.zeros((groups, 256, n), dtype)
    for i in range(8):  # the second half of each prefix is the first half and one component more
        table[:, 1 << i : 2 << i] = table[:, : 1 << i] + by[:, i, None]
    return table


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[candidate, anchor]: inner products from tables and planes, by lookups, shifts and additions."""
    n, count, groups = planes.shape
    out = np.zeros((n, table.shape[2]), table.dtype)
    for lo in range(0, n, ROWS):
        part, at = out[lo : lo + ROWS], planes[lo : lo + ROWS]
        for plane in range(count - 1, -1, -1):
            part <<= 1
            for g in range(groups):
                found = table[g][at[:, plane, g]]
                if plane == count - 1:
                    part -= found
                else:
                    part += found
    return out


def _leading(score: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n highest scores, highest first, ties to the earlier position."""
    if len(score) > 4 * n:
        near = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
        return near[np.argsort(-score[near], kind="stable")[:n]]
    return np.argsort(-score, kind="stable")[:n]


class Tile:
    """Candidates in order of label and id, with their packed planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.planes = ids[order], labels[order], planes[order]
        self.by_id = np.argsort(self.ids, kind="stable")

    def positives(self, anchors: list, vectors: np.ndarray, dtype: type, n: int) -> Iterator[tuple]:
        """(place of the anchor, id, score) of the n best rows of its label and another id; anchors are in order of label."""
        labels = np.array([a["label"] for a in anchors], np.int64)
        for label in np.unique(labels):
            lo, hi = np.searchsorted(self.labels, label), np.searchsorted(self.labels, label, "right")
            if lo == hi:
                continue
            own = np.flatnonzero(labels == label)
            found = np.ascontiguousarray(scores(subset_sums(vectors[own], dtype), self.planes[lo:hi]).T)
            for i, score in zip(own, found):
                near = np.flatnonzero(self.ids[lo:hi] != anchors[i]["anchor_id"])
                for k in near[_leading(score[near], n)]:
                    yield i, self.ids[lo + k], score[k]

    def negatives(self, anchors: list, vectors: np.ndarray, dtype: type, n: int, least: int, most: int) -> Iterator[tuple]:
        """(place of the anchor, number of the positive, id, score) of the n best rows of another label between the positive's bounds."""
        found = np.ascontiguousarray(scores(subset_sums(vectors, dtype), self.planes[self.by_id]).T)
        ids, labels = self.ids[self.by_id], self.labels[self.by_id]
        for i, a in enumerate(anchors):
            # exact bounds in whole numbers: least * p <= 100 * s <= most * p
            bounds = [(-(-least * p["score"] // 100), most * p["score"] // 100) for p in a["positives"]]
            score = found[i]
            some = np.flatnonzero((score >= min(b[0] for b in bounds)) & (score <= max(b[1] for b in bounds)) & (labels != a["label"]))
            score, some_ids = score[some], ids[some]
            for k, (low, high) in enumerate(bounds):
                near = np.flatnonzero((score >= low) & (score <= high))
                for j in near[_leading(score[near], n)]:
                    yield i, k, some_ids[j], score[j]


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive the first `negatives` rows of another label.

    Both tables have an id, a vector and a whole label. Components become
    floor(scale * x); a row's score is its inner product with the anchor.
    Higher scores come first, ties by the smaller id. An anchor's positives are
    its first `positives` rows of the same label and another id. Its negatives
    for a positive of score p are rows of another label with
    least * p <= 100 * score <= most * p; a p below zero has none.

    Rows with a null id, label or vector, an empty vector, or a null or
    non-finite component take no part; nor do rows of another size than most
    vectors have. Components are held within the greatest magnitude whose
    scores fit 63 bits (2**28 - 1 at 64 dimensions: x beyond a million). Rows
    that repeat an id are candidates each for itself, and anchors of one id
    and different contents are anchors each for itself; equal anchors count
    once. Empty tables: empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    narrow = dict(vectors.dtypes)[vec_col] == "array<float>"
    read = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<float>" if narrow else "array<double>").alias("vec")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    rows, asked = read(vectors), read(anchors)
    size = F.size("vec").alias("d")
    about = rows.groupBy(size).agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("vec"), -F.array_min("vec"))).cast("double").alias("most")).orderBy(F.desc("n"), "d").first()
    if about is None:
        return spark.createDataFrame([], schema)
    dim, most_c = about.d, int(min(about.most * scale, float(limit(about.d)))) + 1
    planes = most_c.bit_length() + 1
    groups = -(-dim // 8)
    # tiles: enough for all cores twice, and none over TILE rows
    tiles = max(2 * spark.sparkContext.defaultParallelism, -(-about.n // TILE))

    def coded(batches: Iterable[pa.RecordBatch], as_planes: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = whole(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
                raw = packed(c, planes) if as_planes else c.astype("<i8")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in raw], pa.binary())], names=["id", "label", "data"])

    kind = "id long, label long, data binary"
    tile = F.pmod(F.xxhash64("id", "label", "data"), F.lit(tiles)).cast("int")
    candidates = rows.where(F.size("vec") == dim).mapInArrow(lambda b: coded(b, True), kind).withColumn("tile", tile)
    own = stored(asked.where(F.size("vec") == dim).mapInArrow(lambda b: coded(b, False), kind).distinct().withColumn("key", F.xxhash64("label", "data")).withColumnsRenamed({"id": "anchor_id"}))
    pair = "array<struct<id:long,score:long>>"

    def past(anchor_rows: DataFrame, of: str) -> DataFrame:
        """Anchors streamed past every tile. Candidates of a tile come first, then anchors in order of label."""
        sent = anchor_rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        none = F.lit(None).cast("long")
        all_rows = candidates.select("tile", F.lit(0).alias("kind"), "id", "label", "data", none.alias("key"), F.lit(None).cast(pair).alias("positives"))
        all_rows = all_rows.union(sent.select("tile", F.lit(1).alias("kind"), F.col("anchor_id"), "label", "data", "key", "positives"))
        dealt = all_rows.repartition(tiles, "tile").sortWithinPartitions("tile", "kind", "label")

        def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts, held = None, [], None
            waiting: list = []

            def answered() -> pa.RecordBatch:
                c = np.frombuffer(b"".join(a["data"] for a in waiting), "<i8").reshape(-1, dim)
                # sums of products fit 32 bits or take 64
                bound = int(np.abs(c).sum(1).max()) << planes
                number = np.int32 if bound < 1 << 31 else np.int64
                found = list(held.positives(waiting, c, number, positives) if of == "positives" else held.negatives(waiting, c, number, negatives, least, most))
                out = [[waiting[f[0]]["anchor_id"] for f in found], [waiting[f[0]]["key"] for f in found], [f[1] if of == "negatives" else 0 for f in found], [int(f[-2]) for f in found], [int(f[-1]) for f in found]]
                waiting.clear()
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "key", "number", "id", "score"])

            for b in batches:
                of_tile, of_kind = b.column(0).to_numpy(), b.column(1).to_numpy()
                edge = [0, *(np.flatnonzero(np.diff(of_tile) | np.diff(of_kind)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(edge, edge[1:]):
                    if lo == hi:
                        continue
                    if of_tile[lo] != now:
                        if waiting and held:
                            yield answered()
                        waiting.clear()
                        now, parts, held = of_tile[lo], [], None
                    part = b.slice(lo, hi - lo)
                    if of_kind[lo] == 0:
                        raw = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(-1, planes, groups)
                        parts.append((part.column(2).to_numpy(), part.column(3).to_numpy(), raw))
                        continue
                    if parts:
                        held, parts = Tile(*(np.concatenate(x) for x in zip(*parts))), []
                    if not held:
                        continue  # a tile without candidates has nothing to say
                    for row in part.select([2, 3, 4, 5, 6]).rename_columns(["anchor_id", "label", "data", "key", "positives"]).to_pylist():
                        waiting.append(row)
                        if len(waiting) == ANCHORS:
                            yield answered()
            if waiting and held:
                yield answered()

        return dealt.mapInArrow(met, "anchor_id long, key long, number long, id long, score long")

    order = [F.desc("score"), "id"]
    best = past(own.withColumn("positives", F.lit(None).cast(pair)), "positives").withColumn("n", F.row_number().over(W.partitionBy("anchor_id", "key").orderBy(*order))).where(F.col("n") <= positives)
    lists = best.groupBy("anchor_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id", "score"))), lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    ready = stored(own.join(lists, ["anchor_id", "key"]))
    found = past(ready, "negatives").withColumn("rank", F.row_number().over(W.partitionBy("anchor_id", "key", "number").orderBy(*order))).where(F.col("rank") <= negatives)
    told = ready.select("anchor_id", "key", F.posexplode("positives").alias("number", "p"))
    return found.join(told, ["anchor_id", "key", "number"]).select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
