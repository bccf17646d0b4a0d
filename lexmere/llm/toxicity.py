"""Toxicity by a support vector machine over gapped subsequences, with Nyström landmarks.

The kernel of two units is the inner product of their gap-weighted
subsequences of LENGTH characters: one that spans s characters weighs DECAY**s,
so an inserted or left out character lowers a match and does not end it. Spans
are at most REACH characters and units begin with a mark of their own. Units
are words, and runs of single characters over blanks (`i d i o t`), which are
one; a unit with signs inside is also looked at with these as gaps that weigh
nothing, and has the worse of both scores. The kernel is normalised and raised
to POWER. A unit is mapped by its kernel values with landmarks taken from the
training sample, whitened by the landmarks' own kernel matrix, and scored by a
linear SVM; a text's probability is fitted to its worst units' SVM scores, in
which no weight is negative, so that a worse unit never lowers it. Landmarks are
toxic words, clean words that are near to them, and common ones.

Units of training texts share their text's label, so the SVM is trained in
rounds: toxic texts are represented by the units that score highest so far,
clean texts by all their units that the round before found most toxic. Clean
texts into which one toxic landmark, or an altered form of it, is put are
learned from as toxic texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm import labelled
from lexmere.llm.memory import give_back

#: Subsequence length, longest span, weight of each spanned character, and power of the normalised kernel.
LENGTH, REACH, DECAY, POWER = 3, 7, 0.9, 2
#: Buckets that subsequences are hashed to, landmarks, and characters of a word that are looked at in one piece.
BUCKETS, LANDMARKS, PIECE = 1 << 18, 96, 24
#: Signed chi-square from which a word may be a toxic landmark (a quarter of the best one's, where that is less), and clean words near to these that are landmarks too.
SURE, HARD = 12.0, 48
#: Words that a worker remembers scores of, words whose kernel is computed at once, rounds of training, steps of a round.
CACHE, BLOCK, ROUNDS, STEPS = 150_000, 512, 3, 3000
#: Word scores at which a text's score may bend.
KNEES = (0.0, 0.4, 1.0, 3.0)
#: Log odds of a model that has nothing to learn from: every text counts as clean, so none is rejected.
UNTRAINED = -30.0
#: Most toxic landmarks whose altered forms are learned from as well.
WORST = 24

#: Clean texts of the sample that a toxic landmark is put into, and what share of all weight they have.
PUT, PUT_WEIGHT = 240, 0.02

_SIGNS, _TRIM = re.compile(r"[\W_]+"), re.compile(r"^[\W_]+|[\W_]+$")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_OFFSETS = [(0, *rest) for rest in combinations(range(1, REACH), LENGTH - 1)]
#: Weight of a subsequence by its span.
_WEIGHT = DECAY ** np.arange(REACH + 1)


def trimmed(unit: str) -> str:
    """A unit without the signs around it; one of signs alone stays."""
    return unit if unit.isalnum() else _TRIM.sub("", unit) or unit


def bare(unit: str) -> str:
    """A unit without any signs; one of signs alone stays."""
    return unit if unit.isalnum() else _SIGNS.sub("", unit) or unit


def words(text: str) -> list[str]:
    """Units in lower case: runs of anything but white space, those over PIECE characters in overlapping pieces, and runs of single characters as one."""
    low = text.lower()
    found = low.split()
    if max(map(len, found), default=0) > PIECE:
        found = [p for w in found for p in ([w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)])]
    for m in _SPACED.finditer(low) if sum(map((1).__eq__, map(len, found))) > 2 else ():
        run = "".join(m[0].split())
        found += [run[i : i + PIECE] for i in range(0, max(1, len(run) - PIECE // 2), PIECE // 2)]
    return found


def subsequences(many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit number, bucket, span) of every subsequence of each unit; outer signs are trimmed and the start is marked."""
    short = ["^" + trimmed(w) for w in many]
    width = max(map(len, short), default=1) + REACH
    codes = np.frombuffer("".join(w.ljust(width, "\0") for w in short).encode("utf-32-le"), np.uint32).reshape(-1, width).astype(np.uint64)
    rows, buckets, spans = [], [], []
    seen: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {(): (np.zeros((len(short), width - REACH), np.uint64), np.ones((len(short), width - REACH), bool))}
    for at in _OFFSETS:
        for k in range(LENGTH):
            if at[: k + 1] not in seen:
                h, whole = seen[at[:k]]
                c = codes[:, at[k] : at[k] + h.shape[1]]
                h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                seen[at[: k + 1]] = h, whole & (c > 0)
        h, whole = seen.pop(at)
        r, p = np.nonzero(whole)
        rows.append(r)
        buckets.append((h[r, p] % np.uint64(BUCKETS)).astype(np.int64))
        spans.append(np.full(len(r), at[-1] + 1))
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(spans)


class Kernel:
    """Kernel values of words with a fixed list of landmarks."""

    def __init__(self, landmarks: list[str]) -> None:
        r, b, span = subsequences(landmarks)
        # a bucket is in few landmarks: these stand one after another, `many` of them from `first` on
        key, at = np.unique(b * len(landmarks) + r, return_inverse=True)
        self.size, self.landmark, self.value = len(landmarks), key % len(landmarks), np.bincount(at, _WEIGHT[span], len(key))
        norm = np.sqrt(np.bincount(self.landmark, self.value**2, len(landmarks)))
        self.value = self.value / np.where(norm > 0, norm, 1)[self.landmark]
        self.many = np.bincount(key // len(landmarks), minlength=BUCKETS).astype(np.int32)
        self.first = (np.cumsum(self.many) - self.many).astype(np.int32)

    def __call__(self, many: list[str]) -> np.ndarray:
        out = np.empty((len(many), self.size), np.float32)
        for lo in range(0, len(many), BLOCK):
            part = many[lo : lo + BLOCK]
            r, b, span = subsequences(part)
            # a unit's own norm: weights of equal subsequences are summed, in keys that sort with their span
            key = np.sort((r * BUCKETS + b) * (REACH + 1) + span)
            weight, key = _WEIGHT[key % (REACH + 1)], key // (REACH + 1)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            norm = np.sqrt(np.bincount(key[first] // BUCKETS, np.add.reduceat(weight, first) ** 2, len(part))) if len(key) else np.zeros(len(part))
            known = np.flatnonzero(self.many[b])
            times = self.many[b[known]]
            at = np.repeat(self.first[b[known]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            value = np.repeat(_WEIGHT[span[known]], times) * self.value[at]
            got = np.bincount(np.repeat(r[known], times) * self.size + self.landmark[at], value, len(part) * self.size).reshape(len(part), self.size)
            out[lo : lo + BLOCK] = (got / np.where(norm > 0, norm, 1)[:, None]) ** POWER
        return out


class Model:
    """Landmarks, the SVM's weights on them, and the scale from words' scores to a probability."""

    def __init__(self) -> None:
        self.landmarks: list[str] = []
        self.weights, self.bias = np.zeros(0), 0.0
        self.scale = np.append(np.zeros(len(KNEES) + 4), UNTRAINED)

    def word_scorer(self) -> Words:
        return Words(self)


class Words(dict):
    """Word -> SVM score, new words in groups; emptied when full."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.kernel = model, Kernel(model.landmarks) if model.landmarks else None

    def learn(self, many: Iterable[str]) -> None:
        many = set(many)
        new = [w for w in many if w not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(many)
        if new and self.kernel:
            # forms that are no units themselves are not remembered: they would crowd these out
            form = {w: (trimmed(w), bare(w)) for w in new}
            todo = [f for f in {f for fs in form.values() for f in fs} if f not in self]
            scored = dict(zip(todo, (self.kernel(todo) @ self.model.weights + self.model.bias).tolist())) if todo else {}
            self.update({w: max(scored.get(f, self.get(f)) for f in fs) if fs[0] != fs[1] else scored.get(fs[0], self.get(fs[0])) for w, fs in form.items()})

    def features(self, found: list[str]) -> np.ndarray:
        """What is known of a text: its worst word's score, in ramps between -1, KNEES and 5, and how many words are beyond each of two of them, and beyond the margin per word."""
        if not self.kernel or not found:
            return np.zeros(len(KNEES) + 4)
        s = list(map(self.__getitem__, found))
        worst = max(s)
        over = sum(x > KNEES[0] for x in s) if worst > KNEES[0] else 0
        far = sum(x > KNEES[-1] for x in s) if worst > KNEES[-1] else 0
        return np.array([*(min(max(worst, lo), hi) - lo for lo, hi in zip((-1.0, *KNEES), (*KNEES, 5.0))), np.log1p(over), np.log1p(far), 20 * over / (20 + len(s))])


def _landmarks(names: list[str], of: list[np.ndarray], y: np.ndarray) -> list[str]:
    """Words whose share of toxic texts differs most from that of clean ones, by the signed chi-square of the two counts, and as contrast clean words whose kernel with these is greatest, and common words."""
    short = [trimmed(w) for w in names]
    number = {w: i for i, w in enumerate(dict.fromkeys(short))}
    to = np.array([number[w] for w in short])
    toxic, clean = _counts([np.unique(to[t]) for t in of], y, len(number))
    p, n = y.sum(), len(y) - y.sum()
    expected = (toxic + clean) * p / (p + n)
    gain = np.where(toxic > 1, (toxic - expected) * np.abs(toxic - expected) / (expected + 1), -np.inf)
    words_ = np.array(list(number), dtype=object)
    order = sorted(np.argsort(-gain, kind="stable")[: LANDMARKS * 3].tolist(), key=lambda i: (-gain[i], words_[i]))
    worst = [words_[i] for i in order if gain[i] > 0 and gain[i] >= min(SURE, gain.max() / 4)][: LANDMARKS * 3 // 4]
    common = [words_[i] for i in np.lexsort((np.arange(len(clean)), -clean)) if clean[i] and words_[i] not in set(worst)]
    often = [w for w in common if clean[number[w]] > 1 and toxic[number[w]] * n < clean[number[w]] * p] if worst else []
    close = Kernel(worst)(often).max(1) * np.log1p(clean[[number[w] for w in often]]) if often else np.zeros(0)
    hard = [often[i] for i in np.argsort(-close, kind="stable")[:HARD]]
    return worst + hard + [w for w in common if w not in set(hard)][: LANDMARKS // 8]


def _counts(of: list[np.ndarray], y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(toxic texts, clean texts) that hold each word."""
    both = [np.bincount(np.concatenate([t for t, label in zip(of, y) if label == k] or [np.zeros(0, np.int64)]), minlength=n) for k in (1, 0)]
    return both[0], both[1]


def variants(word: str) -> list[str]:
    """The word with a letter put into it at each inner place: what is hidden stays what it was. (Signs and blanks are dealt with by the units.)"""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in ("x", word[i - 1], "aeioulrnst"[i % 10])]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM by averaged stochastic subgradient steps, examples drawn by weight."""
    r = np.random.default_rng(seed)
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w, mean = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    drawn = r.choice(len(x), (STEPS, 64), p=weight / weight.sum())
    for t, at in enumerate(drawn, 1):
        rate = min(1.0, 1 / (ridge * (t + 200)) / 20)
        bad = y[at] * (x[at] @ w) < 1
        w *= 1 - rate * ridge
        w += rate / len(at) * (y[at][bad, None] * x[at][bad]).sum(0)
        if t > STEPS // 2:
            mean += w
    mean /= STEPS - STEPS // 2
    return mean[:-1], float(mean[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    ridge, s = np.diag([0.01] * (x.shape[1] - 1) + [1e-6]), np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ s, -30, 30)))
        s = s - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ s)
    return s


def train(texts: list[str], y: np.ndarray) -> Model:
    model = Model()
    if not len(y) or y.min() == y.max():
        return model
    number: dict[str, int] = {}
    of = [np.array([number.setdefault(w, len(number)) for w in dict.fromkeys(words(t))], np.int64) for t in texts]
    names = list(number)
    model.landmarks = _landmarks(names, of, y) if names else []
    if not model.landmarks:
        return model
    kernel = Kernel(model.landmarks)
    values, vectors = np.linalg.eigh(kernel(model.landmarks).astype(np.float64))
    keep = values > values.max() * 1e-5
    white = vectors[:, keep] / np.sqrt(values[keep])
    k = np.concatenate([kernel(names[lo : lo + 8192]).astype(np.float16) for lo in range(0, len(names), 8192)])
    toxic, clean = _counts(of, y, len(names))
    sure = [w for w in model.landmarks[:WORST] if w in number and toxic[number[w]] >= y.sum() / 20 and clean[number[w]] <= 1]
    altered = kernel([v for w in sure for v in variants(w)] or ["^"])
    score = (toxic + 0.1) / (toxic + clean + 1) * np.log1p(toxic + clean)  # before the first round: how much a word is a toxic text's
    for turn in range(ROUNDS):
        rows, label, weight = [], [np.ones(len(altered))], [np.full(len(altered), 0.7 / len(altered))]
        for t, toxic_text in zip(of, y):
            if not len(t):
                continue
            order = t[np.argsort(-score[t], kind="stable")][: 3 if toxic_text else 12]
            rows.append(order)
            label.append(np.full(len(order), 1.0 if toxic_text else -1.0))
            weight.append(np.full(len(order), (1 / y.sum() if toxic_text else 1 / (len(y) - y.sum())) / len(order)) * (np.array([1.0, 0.5, 0.25])[: len(order)] if toxic_text else 1))
        x = np.concatenate([altered, k[np.concatenate(rows)]]).astype(np.float32) @ white.astype(np.float32)
        w, bias = _svm(x, np.concatenate(label), np.concatenate(weight), turn)
        model.weights, model.bias = white @ w, bias
        score = np.concatenate([k[lo : lo + 8192].astype(np.float32) @ model.weights for lo in range(0, len(k), 8192)]) + bias
    scorer = model.word_scorer()
    scorer.update(zip(names, score.tolist()))
    x = np.array([(*scorer.features(words(t)), 1.0) for t in texts])
    weight = np.ones(len(y))
    clean_texts = [t for t, label in zip(texts, y) if not label][:PUT] if sure else []
    if clean_texts:
        # the landmark, or one of its altered forms, in turn
        forms = [f for w in sure for f in (w, ".".join(w), " ".join(w), w[: len(w) // 2] + "*" + w[len(w) // 2 :], *variants(w)[::3])]
        order = np.random.default_rng(3).permutation(len(forms))
        put = [f"{t} {forms[order[i % len(forms)]]}" for i, t in enumerate(clean_texts)]
        scorer.learn(u for t in put for u in words(t))
        x = np.concatenate([x, [(*scorer.features(words(t)), 1.0) for t in put]])
        y = np.append(y, np.ones(len(put)))
        weight = np.append(weight, np.full(len(put), PUT_WEIGHT * len(texts) / len(put)))
    # more toxic words never lower a score: what has a negative weight is left out
    used = np.ones(x.shape[1], bool)
    while True:
        s = _logistic(x[:, used], y, weight)
        bad = np.flatnonzero(used)[:-1][s[:-1] < 0]
        if not len(bad):
            break
        used[bad] = False
    model.scale = np.zeros(len(used))
    model.scale[used] = s
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model trained on labelled.sample(); without labelled rows of both kinds it calls every text clean."""
    texts, y = labelled.sample(docs, labels, label, most_bytes=6 << 20)
    model = train([t.decode() for t in texts], y)
    give_back()  # the driver goes on with other work
    return model


def score_texts(scorer: Words, texts: list[str]) -> np.ndarray:
    found = [words(t) for t in texts]
    scorer.learn(set().union(*found))
    x = np.array([(*scorer.features(t), 1.0) for t in found]).reshape(-1, len(scorer.model.scale))
    return 1 / (1 + np.exp(-np.clip(x @ scorer.model.scale, -30, 30)))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row: the probability of label 1, from the whole text alone.

    Null, empty and blank texts get the score of a text without a toxic word.
    Null ids and repeated rows stay, an empty table gives an empty result,
    other columns are not read.
    """

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.word_scorer()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(scorer, [t or "" for t in part.column(1).to_pylist()]))], names=["id", "score"])
        scorer.clear()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(of, "id long, score double")


def keep_clean(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """docs whose score is under `least`, in one pass without a shuffle; columns as given."""
    at = docs.columns.index(text_col)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.word_scorer()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                clean = score_texts(scorer, [t or "" for t in part.column(at).to_pylist()]) < least
                yield part.filter(pa.array(clean))
        scorer.clear()
        give_back()

    return docs.mapInArrow(of, docs.schema)
