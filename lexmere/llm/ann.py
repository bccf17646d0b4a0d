"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are dealt to coarse lists by their nearest centre. A vector's code is
the signs of its rotated offset from the centre, in packed bits. Two scalars,
the offset's length and the inner product of its direction with its own code,
turn the inner product of a query with the code into an unbiased estimate of
the inner product with the vector, with a bound on the error. A query is
rounded to BITS bits a coordinate, so its inner product with a code is a few
counts of common bits: codes are never unpacked. Vectors whose lower bound of
the distance is no more than the k-th exact distance so far are reranked on the
original vectors; no other vector is looked at.

Lists are cut into tiles of bounded size. A tile's codes and vectors are
shuffled once and held by one task, past which the queries that probe its list
stream; each brings back k rows per tile. How many lists a query probes is
measured on the sample that the centres are fitted on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that centres are fitted on, rows to a list, lists at most, and rows in a tile.
SAMPLE, LIST, LISTS, TILE = 16_384, 4096, 1024, 1 << 17
#: Share of the sample's neighbours that the probed lists must hold, and queries of the sample that it is measured with.
COVER, ASKED = 0.98, 256
#: Width of the error bound in standard deviations.
EPSILON = 1.3
#: Bits of a query's coordinate; codes and queries that are met at once.
BITS, CODES, QUERIES = 4, 1 << 15, 16
#: Vectors that are so many times larger than most have no code and are met exactly.
FAR = 1e60


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column, dim: int | Column) -> Column:
    """True for vectors of that size whose components are finite and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def encode(offset: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits in 64-bit words, lengths, inner products with the own code) of offsets from the centre."""
    y = offset @ turn
    length = np.sqrt((y * y).sum(1))
    own = np.abs(y).sum(1) / np.sqrt(y.shape[1]) / np.where(length > 0, length, 1)
    bits = np.packbits(y > 0, axis=1)
    words = np.zeros((len(y), -(-y.shape[1] // 64) * 8), np.uint8)
    words[:, : bits.shape[1]] = bits
    return words.view(np.uint64), length, np.where(own > 0, own, 1)


def planes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bit planes in 64-bit words [query, bit, word], least coordinate, step) of queries' rotated directions, rounded to BITS bits."""
    low = unit.min(1, keepdims=True)
    step = (unit.max(1, keepdims=True) - low) / ((1 << BITS) - 1)
    whole = np.rint((unit - low) / np.where(step > 0, step, 1)).astype(np.uint8)
    words = np.zeros((len(unit), BITS, -(-unit.shape[1] // 64) * 8), np.uint8)
    for k in range(BITS):
        bits = np.packbits(whole >> k & 1, axis=1)
        words[:, k, : bits.shape[1]] = bits
    return words.view(np.uint64), low[:, 0], step[:, 0]


def common(of: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of rounded coordinates over each code's bits [query, code], from counts of common bits."""
    total = np.zeros((len(of), len(words)), np.float32)
    for w in range(words.shape[1]):
        part = np.zeros(total.shape, np.uint16)
        for k in range(BITS):
            part += np.bitwise_count(of[:, k, w, None] & words[None, :, w]).astype(np.uint16) << k
        total += part
    return total


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact distances of one query from rows; magnitudes whose squares would not fit are scaled first."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        d = x - q
        square = np.einsum("ij,ij->i", d, d)
        odd = np.flatnonzero(~((square > 1e-280) & (square < 1e300)))
        plain = np.sqrt(square)
        if len(odd):
            most = np.abs(d[odd]).max(1)
            fine = (most > 0) & np.isfinite(most)
            plain[odd[~fine]] = most[~fine]
            part = d[odd[fine]] / most[fine, None]
            plain[odd[fine]] = most[fine] * np.sqrt((part * part).sum(1))
        return plain


def best(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least, ties to the smaller id; one position for each id."""
    order = np.lexsort((ids, distance))
    if len(order) > 4 * k and len(set(ids[order[:k]].tolist())) == k:
        return order[:k]
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:k]


class Tile:
    """Codes, and apart from them the vectors, of up to TILE rows of one list."""

    def __init__(self, ids: np.ndarray, words: np.ndarray | None, length: np.ndarray, own: np.ndarray, x: np.ndarray, centre: np.ndarray, turn: np.ndarray, unit: float) -> None:
        self.ids, self.words, self.x, self.centre, self.turn, self.unit = ids, words, x, centre, turn, unit
        if words is not None:
            dim = x.shape[1]
            self.flat = (length * length).astype(np.float32)
            self.scale = (2 * length / own / np.sqrt(dim)).astype(np.float32)
            self.error = (2 * length * EPSILON * np.sqrt(np.maximum(1 - own * own, 0)) / own / np.sqrt(max(dim - 1, 1))).astype(np.float32)
            self.bits = np.bitwise_count(words).sum(1).astype(np.float32)

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the (ids, exact distances) of its k nearest here."""
        kept = [(self.ids[:0], np.zeros(0))] * len(q)

        def add(i: int, at: np.ndarray) -> None:
            at = at[self.ids[at] != q_ids[i]]
            if len(at):
                d = distances(q[i], self.x[at].astype(np.float64, copy=False))
                if len(kept[i][0]) == k:
                    some = d <= kept[i][1][-1]
                    at, d = at[some], d[some]
                ids, d = np.concatenate([kept[i][0], self.ids[at]]), np.concatenate([kept[i][1], d])
                top = best(d, ids, k)
                kept[i] = ids[top], d[top]

        coded = np.zeros(len(q), bool)
        if self.words is not None:
            with np.errstate(over="ignore", invalid="ignore"):
                y = (q / self.unit - self.centre) @ self.turn
                far = np.sqrt((y * y).sum(1))
            coded = np.isfinite(far) & (far < 1e15)
        for i in np.flatnonzero(~coded):
            for lo in range(0, len(self.ids), CODES):
                add(i, np.arange(lo, min(lo + CODES, len(self.ids))))
        asked = np.flatnonzero(coded)
        for at in range(0, len(asked), QUERIES):
            some = asked[at : at + QUERIES]
            unit = y[some] / np.where(far[some] > 0, far[some], 1)[:, None]
            of, least, step = planes(unit)
            size, total = far[some].astype(np.float32)[:, None], unit.sum(1)
            # distance² = flat + size² - size * scale * <direction, code>, the last from common bits
            a, b = (2 * step).astype(np.float32)[:, None], (2 * least).astype(np.float32)[:, None]
            rounding = (step / 2 * np.sqrt(self.x.shape[1])).astype(np.float32)[:, None] * 0.3
            for lo in range(0, len(self.ids), CODES):
                part = slice(lo, lo + CODES)
                inner = common(of, self.words[part])
                inner *= a
                inner += b * self.bits[part] - total.astype(np.float32)[:, None]
                guess = size * self.scale[part] * -inner
                guess += self.flat[part] + size * size
                low = guess - size * (self.error[part] + rounding * self.scale[part])
                for j, i in enumerate(some):
                    if len(kept[i][0]) < k:
                        n = min(4 * k, guess.shape[1])
                        add(i, lo + np.argpartition(guess[j], n - 1)[:n])
                    most = kept[i][1][-1] / self.unit if len(kept[i][0]) == k else np.inf
                    near = np.flatnonzero(low[j] <= most * most * (1 + 1e-4) + 1e-6 * float(size[j, 0]) ** 2)
                    if len(near):
                        add(i, lo + near)
        return kept


class Coarse:
    """Centres in units of the usual length, how many lists a query probes, and that unit."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        most = np.abs(sample).max(1)
        self.unit = float(2.0 ** np.clip(np.rint(np.log2(np.median(most))), -1000, 1000))
        x = sample[(most / self.unit) < FAR] / self.unit
        r = np.random.default_rng(5)
        self.centres = x[r.choice(len(x), min(lists, len(x)), replace=False)].copy()
        for _ in range(8):
            own = self.order(x, 1)[:, 0]
            count = np.bincount(own, minlength=len(self.centres))
            total = np.zeros_like(self.centres)
            np.add.at(total, own, x)
            self.centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], self.centres)
        own = self.order(x, 1)[:, 0]
        ranks = []
        for i in r.choice(len(x), min(ASKED, len(x)), replace=False):
            d = distances(x[i], x)
            near = np.argsort(d, kind="stable")[1 : min(11, max(2, len(x) // 100))]
            place = np.argsort(self.order(x[i : i + 1], len(self.centres))[0])
            ranks += place[own[near]].tolist()
        self.probes = min(len(self.centres), int(np.quantile(ranks, COVER)) + 1) if ranks else len(self.centres)

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centres of each row, nearest first."""
        d = (self.centres**2).sum(1) - 2 * (x @ self.centres.T)
        if n == 1:
            return d.argmin(1)[:, None]
        return np.argsort(d, 1, kind="stable")[:, :n]

    def lists(self, x: np.ndarray) -> np.ndarray:
        """List of each row; the one after the last centre takes vectors too large for codes."""
        with np.errstate(over="ignore"):
            x = x / self.unit
        far = ~(np.abs(x).max(1) < FAR)
        out = np.full(len(x), len(self.centres))
        out[~far] = self.order(x[~far], 1)[:, 0]
        return out


def _vectors(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _rows(tile: np.ndarray, kind: int, ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """(tile, kind, id, data): one row per row of the array data."""
    raw = np.ascontiguousarray(data).view(np.uint8).reshape(len(ids), -1)
    ends = pa.py_buffer((np.arange(len(ids) + 1) * raw.shape[1]).astype(np.int32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int64)), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, ends, pa.py_buffer(raw.tobytes())])], names=["tile", "kind", "id", "data"])


def _raw(column: pa.BinaryArray) -> np.ndarray:
    """All bytes of a binary column, rows one after another."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", per_list: int = LIST, per_tile: int = TILE) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest rows of `vectors` by Euclidean distance, nearest first, ties to the smaller id.

    Both tables have id_col and vec_col. The size that most vectors have is the
    index's; vectors of another size, null, zero or holding null or non-finite
    components, and rows with a null id, take no part on either side. A query's
    candidates are all rows of another id; rows that repeat an id count once,
    at their smallest distance. Fewer than k candidates: all that the probed
    lists hold. Finite vectors of any magnitude take part. Empty tables: empty
    result. Other columns are not read.

    Distances are exact (double precision on the original vectors). A true
    neighbour is missed if its list is not probed, which COVER bounds, or if
    its estimate errs by more than EPSILON standard deviations.
    """
    spark = queries.sparkSession
    wide = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    number = np.float32 if wide == "array<float>" else np.float64
    v = F.col(vec_col).cast(wide)
    all_rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))
    sizes = all_rows.groupBy(F.size("vec").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes.d
    rows = all_rows.where(usable(F.col("vec"), dim))
    # the sample is that of least hashes, so it does not depend on the order of rows
    sample = [r.vec for r in rows.orderBy(F.xxhash64("id", F.lit(3)), "id", F.xxhash64("vec")).limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], schema)
    coarse, turn = Coarse(np.array(sample, np.float64), min(LISTS, max(1, sizes["count"] // per_list))), rotation(dim)
    last = len(coarse.centres)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(last + 1, np.int64)
        for b in batches:
            total += np.bincount(coarse.lists(_vectors(b, dim)[1].astype(np.float64)), minlength=last + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(last + 1)), pa.array(total)], names=["list", "n"])

    held = {r.list: r.n for r in rows.select("id", "vec").mapInArrow(counted, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()}
    shards = np.array([-(-held.get(i, 0) // per_tile) for i in range(last + 1)])
    first = np.concatenate([[0], np.cumsum(shards)])

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _vectors(b, dim)
            if not len(ids):
                continue
            own = coarse.lists(x.astype(np.float64))
            spread = ((np.arange(len(ids)) + ids) % np.maximum(shards[own], 1)).astype(np.int64)
            tile = first[own] + spread
            near = own < last
            if near.any():
                words, length, self_inner = encode(x[near].astype(np.float64) / coarse.unit - coarse.centres[own[near]], turn)
                yield _rows(tile[near], 0, ids[near], np.concatenate([words.view(np.float64), length[:, None], self_inner[:, None]], 1))
            yield _rows(tile, 1, ids, x)

    def probing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _vectors(b, dim)
            if not len(ids):
                continue
            whole = x.astype(np.float64)
            own = coarse.lists(whole)
            for lo in range(0, len(ids), 64):
                part = slice(lo, lo + 64)
                order = np.broadcast_to(np.arange(last), (len(ids[part]), last)).copy()
                near = own[part] < last
                order[near] = coarse.order(whole[part][near] / coarse.unit, last)
                ask = np.zeros((len(ids[part]), int(first[-1])), bool)
                for i in range(len(ask)):
                    for a in [*(order[i, : coarse.probes] if near[i] else order[i]), last]:
                        ask[i, first[a] : first[a + 1]] = True
                i, tile = np.nonzero(ask)
                yield _rows(tile, 2, ids[part][i], x[part][i])

    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(usable(F.col("vec"), dim)).distinct()
    kinds = "tile long, kind int, id long, data binary"

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, originals, tile = None, [], [], None

        def built() -> Tile:
            ids = np.concatenate([i for i, _ in originals])
            raw = np.concatenate([d for _, d in originals]).view(number).reshape(-1, dim)
            order = np.argsort(ids, kind="stable")
            if not codes:
                return Tile(ids[order], None, None, None, raw[order], np.zeros(dim), turn, coarse.unit)
            of_codes = np.concatenate([d for _, d in codes]).view(np.float64).reshape(len(ids), -1)
            at = np.searchsorted(first, now, "right") - 1
            # a vector and its code come in the same order of (id, data) only if ids are distinct: codes are made again for ids that repeat
            code_ids = np.concatenate([i for i, _ in codes])
            by = np.argsort(code_ids, kind="stable")
            words, length, own = np.ascontiguousarray(of_codes[by, :-2]).view(np.uint64), of_codes[by, -2], of_codes[by, -1]
            x = raw[order]
            again = np.flatnonzero(np.isin(ids[order], ids[order][1:][np.diff(ids[order]) == 0]))
            if len(again):
                words[again], length[again], own[again] = encode(x[again].astype(np.float64) / coarse.unit - coarse.centres[at], turn)
            return Tile(ids[order], words, length, own, x, coarse.centres[at], turn, coarse.unit)

        for b in batches:
            tiles, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero(np.diff(tiles) | np.diff(kind)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(tiles)]):
                if lo == hi:
                    continue
                if tiles[lo] != now:
                    now, codes, originals, tile = tiles[lo], [], [], None
                ids, data = b.column(2).slice(lo, hi - lo).to_numpy(), _raw(b.column(3).slice(lo, hi - lo))
                if kind[lo] < 2:
                    (codes if kind[lo] == 0 else originals).append((ids.copy(), data.copy()))
                    continue
                if tile is None:
                    if not originals:
                        continue
                    tile = built()
                    codes, originals = [], []
                found = tile.search(ids, data.view(number).reshape(-1, dim).astype(np.float64), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(d) for _, d in found])), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([d for _, d in found]))], names=["query_id", "id", "score"])

    index = rows.select("id", "vec").mapInArrow(placed, kinds)
    dealt = index.union(asked.mapInArrow(probing, kinds)).repartition(max(1, min(20_000, 2 * int(first[-1]))), "tile").sortWithinPartitions("tile", "kind")
    once = dealt.mapInArrow(of, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
