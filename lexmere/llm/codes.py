"""Vector codes by dual-tree Lloyd: a codebook for each part of the vectors, in whole numbers throughout.

Vectors are cut into PARTS equal parts. Blocks of rows become trees once, one
for each part: nodes are halved along their widest dimension, and leaves keep
their box and sum. Each round builds a small tree over the part's entries and
descends both trees together. Bounds on the distances between a node's box and
an entry node's box rule entry nodes out; where one entry is left, the whole
node is assigned by its cached sum and no point is looked at. What is left at
the leaves is settled by whole-number distances, ties to the lower index.

A round's job brings back one sum per part, entry and component; new entries
are its floored quotients. Blocks are a stored table, so rounds read the same
trees and a lost executor costs a retry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.negatives import usable
from lexmere.session import small, stored

#: Parts, entries of a codebook, rounds; rows of a block and of a leaf.
PARTS, ENTRIES, ROUNDS = 8, 16, 6
BLOCK, LEAF = 4096, 32


def limit(dim: int) -> int:
    """The greatest magnitude of a component with which errors of whole vectors fit 63 bits."""
    return min((1 << 30) - 1, (1 << ((62 - (dim - 1).bit_length()) // 2 - 1)) - 1)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """[part, row, component]: floor(scale * x), held within +-limit; sizes that PARTS does not divide are filled up with zeros."""
    n, dim = x.shape
    wide = -(-dim // PARTS) * PARTS
    with np.errstate(over="ignore"):
        c = np.clip(np.floor(x.astype(np.float64) * scale), -limit(wide), limit(wide)).astype(np.int64)
    return np.pad(c, ((0, 0), (0, wide - dim))).reshape(n, PARTS, wide // PARTS).transpose(1, 0, 2)


def halved(x: np.ndarray, depth: int) -> np.ndarray:
    """An order of points in which node i of level l holds places n * i / 2**l up to n * (i + 1) / 2**l, each node cut across its widest dimension."""
    n, order = len(x), np.arange(len(x))
    for level in range(depth):
        edge = n * np.arange((1 << level) + 1) >> level
        now = x[order]
        widest = (np.maximum.reduceat(now, edge[:-1]) - np.minimum.reduceat(now, edge[:-1])).argmax(1)
        node = np.repeat(np.arange(1 << level), np.diff(edge))
        order = order[np.lexsort((now[np.arange(n), widest[node]], node))]
    return order


class PointTree:
    """Points of one part of a block in tree order, with boxes and sums of the nodes of every level."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray) -> None:
        self.points, self.depth = points, (len(low) - 1).bit_length()
        n = len(points)
        self.levels = []  # from the leaves up
        for level in range(self.depth, -1, -1):
            edge = n * np.arange((1 << level) + 1) >> level
            self.levels.insert(0, (low, high, total, edge))
            low, high, total = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2]

    @staticmethod
    def leaves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order, and boxes' low and high ends and sums of the leaves) of points."""
        depth = max(0, -(-len(points) // LEAF) - 1).bit_length()
        order = halved(points, depth)
        now, edge = points[order], (len(points) * np.arange((1 << depth) + 1) >> depth)[:-1]
        return order, np.minimum.reduceat(now, edge), np.maximum.reduceat(now, edge), np.add.reduceat(now, edge)


class EntryTree:
    """Entries of a codebook: levels of nodes down to single entries, each with its parent in the level above."""

    def __init__(self, entries: np.ndarray) -> None:
        k = len(entries)
        depth = k.bit_length() - 1
        self.entries, self.order = entries, halved(entries, depth)
        now, edges = entries[self.order], [k * np.arange((1 << level) + 1) >> level for level in range(depth + 1)]
        edges += [np.arange(k + 1)] * (1 << depth != k)
        self.levels = [(np.minimum.reduceat(now, e[:-1]), np.maximum.reduceat(now, e[:-1]), np.searchsorted(up, e[:-1], "right") - 1) for up, e in zip([edges[0], *edges], edges)]


def assigned(tree: PointTree, book: EntryTree) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """(sums, counts) by entry, the whole nodes that were assigned as (from, to, entry), and the other points' places and entries."""
    k, d = book.entries.shape
    sums, counts, nodes = np.zeros((k, d), np.int64), np.zeros(k, np.int64), []
    low, high, total, edge = tree.levels[0]
    e_low, e_high, _ = book.levels[0]
    alive = np.ones((1, 1), bool)
    last = len(book.levels) - 1
    for step in range(max(tree.depth, last) + 1):
        if 0 < step <= tree.depth:
            low, high, total, edge = tree.levels[step]
            alive = np.repeat(alive, 2, axis=0)
        if 0 < step <= last:
            e_low, e_high, parent = book.levels[step]
            alive = alive[:, parent]
        i, j = np.nonzero(alive)
        if not len(i):
            break
        gap = np.maximum(np.maximum(e_low[j] - high[i], low[i] - e_high[j]), 0)
        reach = np.maximum(high[i] - e_low[j], e_high[j] - low[i])
        near, far = (gap * gap).sum(1), (reach * reach).sum(1)
        best = np.full(len(low), np.iinfo(np.int64).max)
        np.minimum.at(best, i, far)
        # an entry node that is certainly farther than another for every point of the node is out; equal ones stay
        alive[i, j] = near <= best[i]
        if step >= last:
            for node in np.flatnonzero(alive.sum(1) == 1):
                entry = book.order[alive[node].argmax()]
                sums[entry] += total[node]
                counts[entry] += edge[node + 1] - edge[node]
                nodes.append((int(edge[node]), int(edge[node + 1]), int(entry)))
                alive[node] = False
    open_leaves = alive.any(1)
    places = np.flatnonzero(np.repeat(open_leaves, np.diff(edge)))
    points = tree.points[places].astype(np.int64)
    least, code = np.full(len(places), np.iinfo(np.int64).max), np.zeros(len(places), np.int64)
    of = np.repeat(alive, np.diff(edge), axis=0)[places]
    column = np.argsort(book.order)
    for entry in range(k):  # in order of index, so ties stay with the lower
        some = np.flatnonzero(of[:, column[entry]])
        gap = points[some] - book.entries[entry]
        distance = (gap * gap).sum(1)
        better = distance < least[some]
        least[some[better]], code[some[better]] = distance[better], entry
    if len(places):
        # sums of at most BLOCK components of 30 bits are exact in doubles
        sums += ((code == np.arange(k)[:, None]).astype(np.float64) @ points.astype(np.float64)).astype(np.int64)
        counts += np.bincount(code, minlength=k)
    return sums, counts, nodes, places, code


def _trees(row: dict, width: int) -> list[tuple[np.ndarray, PointTree]]:
    """(order, tree) of each part of a stored block."""
    order = np.frombuffer(row["places"], np.uint16).reshape(PARTS, -1)
    points = np.frombuffer(row["points"], np.int32).reshape(PARTS, -1, width)
    boxes = np.frombuffer(row["boxes"], np.int64).reshape(PARTS, 3, -1, width)
    return [(order[p], PointTree(points[p], *boxes[p])) for p in range(PARTS)]


def compressed(vectors: DataFrame, scale: int = 4096, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) per vector, codebooks [part, entry, component]) after `rounds` rounds and a last assignment.

    Components become floor(scale * x). Each part's codebook starts as that
    part of the `entries` rows of smallest ids (null ids last, rows of one id
    in order of their vectors; all rows, if fewer). A round assigns every part
    to the nearest entry, ties to the lower index, and replaces each entry by
    its parts' floored means; entries without parts stay. `code` is the
    entries' indexes in order of parts, two hex digits each, `error` the sum of
    squared distances.

    Rows whose vector is null or empty or holds a null or non-finite component
    are left out, and rows of another size than most vectors have. Sizes that
    the number of parts does not divide are filled up with zeros. Components
    are held within the greatest magnitude whose errors fit 63 bits (2**27 - 1
    at 64 dimensions: x beyond 32,767 at scale 4096). Rows that repeat an id
    are rows each for itself. Empty tables: empty result. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    schema = "id long, label long, code string, error long"
    narrow = dict(vectors.dtypes)[vec_col] == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<float>" if narrow else "array<double>").alias("vec")).where(usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema), np.zeros((PARTS, 0, 0), np.int64)
    dim = sizes.d
    width = -(-dim // PARTS)
    rows = rows.where(F.size("vec") == dim)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    books = whole(np.array([r.vec for r in first], np.float64), scale).copy()
    k = books.shape[1]

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out(ids: list, labels: list, c: np.ndarray) -> pa.RecordBatch:
            made = [PointTree.leaves(c[p]) for p in range(PARTS)]
            places = np.stack([m[0] for m in made]).astype(np.uint16)
            points = np.stack([c[p][m[0]] for p, m in enumerate(made)]).astype(np.int32)
            boxes = np.stack([np.stack(m[1:]) for m in made]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (places, points, boxes))], names=["ids", "labels", "places", "points", "boxes"])

        def merged() -> pa.Table:
            return pa.Table.from_batches(held)

        waiting = 0
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                if waiting + part.num_rows > BLOCK:
                    t = merged()
                    held, waiting = [], 0
                    yield out(*_columns(t, dim, scale))
                held.append(part)
                waiting += part.num_rows
        if waiting:
            yield out(*_columns(merged(), dim, scale))

    tiled = stored(rows.mapInArrow(blocks, "ids array<long>, labels array<long>, places binary, points binary, boxes binary"))
    for _ in range(rounds):
        now = [EntryTree(b) for b in books]

        def counted(batches: Iterable[pa.RecordBatch], now: list = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((PARTS, k, width + 1), np.int64)
            for b in batches:
                for row in b.select([2, 3, 4]).to_pylist():
                    for p, (_, tree) in enumerate(_trees(row, width)):
                        sums, counts, *_ = assigned(tree, now[p])
                        total[p, :, :width] += sums
                        total[p, :, width] += counts
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "value"])

        found = tiled.mapInArrow(counted, "slot long, value long").groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        total = np.zeros(PARTS * k * (width + 1), object)
        for r in found:
            total[r.slot] = int(r.value)
        for (p, i), (*sums, n) in zip(np.ndindex(PARTS, k), total.reshape(-1, width + 1)):
            if n:
                books[p, i] = [s // n for s in sums]
    now = [EntryTree(b) for b in books]

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = len(row["ids"])
                codes, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for p, (order, tree) in enumerate(_trees(row, width)):
                    _, _, nodes, places, code = assigned(tree, now[p])
                    of = np.zeros(n, np.int64)
                    for lo, hi, entry in nodes:
                        of[lo:hi] = entry
                    of[places] = code
                    gap = tree.points - books[p][of]
                    codes[order, p] = of
                    error[order] += (gap * gap).sum(1)
                digits = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array([digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return tiled.mapInArrow(coded, schema), books


def _columns(t: pa.Table, dim: int, scale: int) -> tuple[list, list, np.ndarray]:
    """(ids, labels, whole numbers) of collected rows."""
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column(2).chunks]).reshape(-1, dim)
    return t.column(0).to_pylist(), t.column(1).to_pylist(), whole(x, scale)


def digest(books: np.ndarray) -> str:
    """sha256 of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """(id, label, code, error) with label_error: the errors of all rows of an equal label summed, nulls together; held at the greatest long."""
    rows = stored(rows)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    sums = small(stored(sums.withColumnRenamed("label", "_label")))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
