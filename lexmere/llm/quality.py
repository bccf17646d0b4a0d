"""Quality of documents by a byte-level convolutional network, trained and run in numpy.

Learned filters over WIDTH bytes run over the whole text. Their responses are
max-pooled in chunks of two half chunks, each chunk overlapping the next by
half, and the pooled responses' mean and greatest value over all chunks are
combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm import labelled

#: Bytes of a filter, half a chunk's bytes, filters, and the size of a byte's embedding.
WIDTH, HALF, FILTERS, SIZE = 6, 128, 16, 8
#: Half chunks that are convolved at once.
SLAB = 256
#: Passes over the training sample, documents in a step, and half chunks of a document in a pass.
EPOCHS, BATCH, SEEN = 14, 64, 24

_LOW = np.float32(-1e9)


def halves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array, each padded with zeros to whole half chunks; half chunks of each text; mask of padding."""
    n = np.array([max(1, -(-(len(t) + WIDTH - 1) // HALF)) for t in texts], np.int64)
    data = b"".join(t.ljust(k * HALF, b"\0") for t, k in zip(texts, n.tolist()))
    size = np.array([max(1, len(t)) for t in texts])
    begin = np.cumsum(n * HALF) - n * HALF
    pad = np.arange(len(data)) - np.repeat(begin, n * HALF) >= np.repeat(size, n * HALF)
    return np.frombuffer(data + b"\0" * WIDTH, np.uint8), n, pad


def pooled(half: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, greatest) over a text's chunks of the responses that half chunks have; a chunk is a half and the next one."""
    begin = np.cumsum(n) - n
    last = begin + n - 1
    chunk = half.copy()
    chunk[:-1] = np.maximum(half[:-1], half[1:])
    chunk[last] = half[last]
    whole = np.ones(len(half), bool)
    whole[last[n > 1]] = False  # the last half of longer texts is in the chunk before
    count = np.maximum(1, n - 1)
    shown = np.maximum(chunk, 0)
    mean = np.add.reduceat(np.where(whole[:, None], shown, 0), begin) / count[:, None]
    return mean, np.maximum.reduceat(shown, begin)


class Net:
    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 1, (256, SIZE))
        for of in (range(65, 91), range(97, 123), range(48, 58), range(0x80, 0x100)):  # bytes of a kind begin alike
            self.e[of] = self.e[of] * 0.4 + r.normal(0, 1, SIZE)
        self.w = r.normal(0, 1 / np.sqrt(WIDTH * SIZE), (WIDTH, SIZE, FILTERS))
        self.b = np.zeros(FILTERS)
        self.v = r.normal(0, 0.1, 2 * FILTERS)
        self.c = np.zeros(1)

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter at each of its places."""
        t = np.einsum("bs,wsf->wbf", self.e, self.w)
        t[0] += self.b
        return t.astype(np.float32)

    def train(self, texts: list[bytes], y: np.ndarray, seed: int = 5) -> Net:
        r, params = np.random.default_rng(seed), [self.e, self.w, self.b, self.v, self.c]
        m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        self.c[:] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        for epoch in range(EPOCHS):
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                part = []
                for i in order[at : at + BATCH]:
                    lo = r.integers(0, max(1, len(texts[i]) - SEEN * HALF + 1))
                    part.append(texts[i][lo : lo + SEEN * HALF])
                step += 1
                rate = 0.01 * (1 - epoch / EPOCHS) + 5e-4
                for p, g, a, b in zip(params, self._gradient(part, y[order[at : at + BATCH]]), m, s):
                    g = np.clip(g, -1, 1)
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        self._refit(texts, y)
        return self

    def _gradient(self, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
        data, n, pad = halves(texts)
        t = self.tables()
        conv = t[0][data[: len(pad)]]
        for k in range(1, WIDTH):
            conv += t[k][data[k : len(pad) + k]]
        conv[pad] = _LOW
        conv = conv.reshape(-1, HALF, FILTERS)
        where = conv.argmax(1)
        half = np.take_along_axis(conv, where[:, None], 1)[:, 0].astype(np.float64)
        begin = np.cumsum(n) - n
        doc = np.repeat(np.arange(len(n)), n)
        # chunks, and the half each takes its value from
        i = np.arange(len(half))
        nxt = np.minimum(i + 1, (begin + n - 1)[doc])
        keep = (nxt > i) | (n[doc] == 1)
        i, nxt, d = i[keep], nxt[keep], doc[keep]
        second = half[nxt] > half[i]
        source = np.where(second, nxt[:, None], i[:, None])
        value = np.where(second, half[nxt], half[i])
        shown = np.maximum(value, 0)
        count = np.bincount(d, minlength=len(n))[:, None]
        first = np.searchsorted(d, np.arange(len(n)))
        mean, top = np.add.reduceat(shown, first) / count, np.maximum.reduceat(shown, first)
        f = np.concatenate([mean, top], 1)
        p = 1 / (1 + np.exp(-np.clip(f @ self.v + self.c, -30, 30)))
        g = (p - y) / len(y)
        dv, dc, df = f.T @ g + 1e-4 * self.v, np.array([g.sum()]), g[:, None] * self.v
        dchunk = df[d, :FILTERS] / count[d] + df[d, FILTERS:] * (shown == top[d])
        dchunk = np.where(value > 0, dchunk, 0)
        col = np.broadcast_to(np.arange(FILTERS), source.shape)
        pos = source * HALF + where[source, col]
        g_t = np.empty((WIDTH, 256, FILTERS))
        for k in range(WIDTH):
            g_t[k] = np.bincount((data[pos + k].astype(np.int64) * FILTERS + col).ravel(), dchunk.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return [np.einsum("wbf,wsf->bs", g_t, self.w), np.einsum("wbf,bs->wsf", g_t, self.e) + 1e-5 * self.w, g_t[0].sum(0), dv, dc]

    def _refit(self, texts: list[bytes], y: np.ndarray) -> None:
        """The last layer once more, on whole texts, by Newton steps."""
        f = np.concatenate([Scorer(self).features(texts[i : i + 256]) for i in range(0, len(texts), 256)])
        x = np.concatenate([f, np.ones((len(f), 1))], 1)
        w = np.concatenate([self.v, self.c])
        ridge = np.eye(len(w)) * 1e-2
        ridge[-1, -1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        self.v, self.c = w[:-1], w[-1:]


class Scorer:
    """The trained network as tables over pairs of bytes."""

    def __init__(self, net: Net) -> None:
        t = net.tables()
        self.pairs = [(t[k][:, None] + t[k + 1][None]).reshape(1 << 16, FILTERS) for k in range(0, WIDTH, 2)]
        self.v, self.c = net.v, float(net.c[0])

    def features(self, texts: list[bytes]) -> np.ndarray:
        data, n, pad = halves(texts)
        pair = data[:-1].astype(np.intp) << 8 | data[1:]
        half = np.empty((len(pad) // HALF, FILTERS), np.float32)
        for lo in range(0, len(half), SLAB):
            hi = min(len(half), lo + SLAB)
            a, b = lo * HALF, hi * HALF
            conv = self.pairs[0].take(pair[a:b], 0)
            for k, t in enumerate(self.pairs[1:], 1):
                conv += t.take(pair[a + 2 * k : b + 2 * k], 0)
            conv[pad[a:b]] = _LOW
            half[lo:hi] = conv.reshape(-1, HALF, FILTERS).max(1)
        mean, top = pooled(half, n)
        return np.concatenate([mean, top], 1).astype(np.float64)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.v + self.c, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Net:
    """A network trained on labelled.sample(); without any labelled row it says the same for every text."""
    texts, y = labelled.sample(docs, labels, label)
    net = Net()
    if len(y):
        return net.train(texts, y)
    net.v[:] = 0
    return net


def scores(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row: the probability of label 1, from the whole text alone.

    Null and empty texts are scored as one zero byte. Texts of any length are
    convolved slab by slab. Null ids and repeated rows stay, an empty table
    gives an empty result, other columns are not read.
    """

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = [(t or "").encode("utf-8", "replace") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.score(texts))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(of, "id long, score double")
