"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as an incremental byte-to-text machine.

Whether a merge rule fires at a position depends on text to its right only
through a chain of rules: a rule can lose its right operand (or a token on the
right edge that the operand is built from) to a rule of a strictly lower rank
that starts there, which again depends on a lower rule, and so on. The longest
such chain, in symbols, is the merge list's sufficient lookahead: token
boundaries at least that far from the end of what was read never change. Long
runs of one class of characters are encoded from a buffer of bounded size that
drops tokens once they are stable; shorter words end at a class change and go
through a bounded cache.

The tokenizer file is a `tokenizers` JSON with the normaliser NFC, white space
to blank, lower case; a splitting pattern; byte-level symbols; and an
end-of-word suffix.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.memory import give_back

#: Characters that are normalised and split at once.
SEGMENT = 1 << 16
#: Symbols of a long word that are merged at once, besides the lookahead.
CHUNK = 512
#: Characters beyond which a word is encoded as a stream and not cached.
LONG = 64
#: Characters of texts whose new words are encoded together.
WARM = 1 << 21
#: Entries of the word cache; it is emptied when full.
CACHE = 250_000

#: The splitting pattern of the tokenizer files in use, over normalised text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPLIT = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}"))
_SPACE = regex.compile(r"\p{White_Space}")


def _narrow() -> re.Pattern:
    """PATTERN for texts of Latin-1 characters only, for the faster engine."""
    kinds = defaultdict(str)
    for i in range(256):
        c = chr(i)
        kinds["white" if _SPACE.match(c) else unicodedata.category(c)[0]] += re.escape(c)
    return re.compile(PATTERN.replace(r"[\p{L}]", f"[{kinds['L']}]").replace(r"[\p{N}]", f"[{kinds['N']}]").replace(r"\s\p{L}\p{N}", kinds["white"] + kinds["L"] + kinds["N"]))


_SPLIT_NARROW = _narrow()
_WIDE = re.compile("[^\x00-\xff]")
_LETTERS = regex.compile(r"\p{L}*")
_SIGNS = regex.compile(r"[^\p{White_Space}\p{L}\p{N}]*")


def pieces(text: str) -> list[str]:
    """The words of normalised text."""
    return _SPLIT.findall(text) if _WIDE.search(text) else _SPLIT_NARROW.findall(text)


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself if printable in Latin-1, else the next code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and merge list of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix: str = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.suffix] for s in symbols]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rules = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        self.rank: dict[tuple[int, int], int] = {}
        for k, (a, b, _) in enumerate(self.rules):
            self.rank.setdefault((a, b), k)
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([*self.rank.values()], np.int64)[order]
        self.to = np.array([*(c for _, _, c in self.rules), -1], np.int64)
        self.surface = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.surface[i] = t.encode()
        value = {s: b for b, s in enumerate(symbols)}
        self.bytes = [b""] * len(self.surface)
        for t, i in self.ids.items():
            body, end = (t[: -len(self.suffix)], b" ") if self.suffix and t.endswith(self.suffix) and t not in self.special else (t, b"")
            self.bytes[i] = t.encode() if t in self.special else bytes(value[s] for s in body) + end
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Symbols to the right of a position that can decide whether a merge crosses it."""
        made: dict[int, list[tuple[int, int]]] = defaultdict(list)  # token: (rank, right part)
        size = {i: 1 for i in [*self.inner, *self.last]}
        ranks: dict[int, list[int]] = defaultdict(list)  # left operand: ranks so far, and the longest chain from any of them
        reach: dict[int, list[int]] = defaultdict(list)
        for k, (a, b, c) in enumerate(self.rules):
            more, edge, seen = 0, [(b, k)], set()
            while edge:
                token, below = edge.pop()
                if (token, below) in seen:
                    continue
                seen.add((token, below))
                if at := bisect.bisect_left(ranks[token], below):
                    more = max(more, reach[token][at - 1])
                edge += [(right, r) for r, right in made[token]]
            far = size[b] + more
            ranks[a].append(k)
            reach[a].append(max(far, reach[a][-1]) if reach[a] else far)
            made[c].append((k, b))
            size[c] = size[a] + size[b]
        return max((r[-1] for r in reach.values()), default=1)

    def merged(self, tokens: list[int]) -> list[int]:
        """Apply the merge list to symbols: lowest rank first, leftmost first within a rank."""
        tokens, get, rules, none = list(tokens), self.rank.get, self.rules, len(self.rules)
        ranks = [get(p, none) for p in zip(tokens, tokens[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            to = rules[best][2]
            tokens[i : i + 2] = [to]
            del ranks[i]
            if i:
                ranks[i - 1] = get((tokens[i - 1], to), none)
            if i < len(ranks):
                ranks[i] = get((to, tokens[i + 1]), none)
        return tokens

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.key_rank[at], len(self.rules))

    def many(self, words: list[str]) -> list[bytes]:
        """word() of each, as little-endian bytes: the same merges, one from each word at a time. Words are sorted by length and padded in groups."""
        data = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(d) for d in data])
        out: list[bytes] = [b""] * len(words)
        inner, last, none = np.array(self.inner), np.array(self.last), len(self.rules)
        lo = 0
        for width in (4, 8, 12, 16, 24, 32, 64, 4 * LONG):
            of = np.flatnonzero((size > lo) & (size <= width))
            lo = width
            if not len(of):
                continue
            flat = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in of), np.uint8).reshape(-1, width)
            n, row, col = size[of].copy(), np.arange(len(of)), np.arange(width)
            tok = np.where(col < n[:, None], inner[flat], -1)
            tok[row, n - 1] = last[flat[row, n - 1]]
            rank = np.full(tok.shape, none)
            rank[:, :-1] = self._ranks(tok[:, :-1], tok[:, 1:])
            todo, t, r = row, tok, rank
            while len(todo):
                at = r.argmin(1)
                best = r[np.arange(len(todo)), at]
                if (live := best < none).sum() < len(todo):
                    tok[todo[~live]] = t[~live]
                    todo, t, r, at, best = todo[live], t[live], r[live], at[live], best[live]
                    if not len(todo):
                        break
                k = np.arange(len(todo))
                n[todo] -= 1
                shift = np.minimum(col + (col > at[:, None]), width - 1)
                t, r = np.take_along_axis(t, shift, 1), np.take_along_axis(r, np.minimum(col + (col >= at[:, None]), width - 1), 1)
                t[:, -1], r[:, -1] = -1, none
                t[k, at] = self.to[best]
                before = np.maximum(at - 1, 0)
                r[k, before] = np.where(at > 0, self._ranks(t[k, before], t[k, at]), r[k, before])
                after = np.minimum(at + 1, width - 1)
                r[k, at] = np.where(at + 1 < width, self._ranks(t[k, at], t[k, after]), none)
            small = tok.astype("<u4")
            for i, m, x in zip(of.tolist(), n.tolist(), small):
                out[i] = x[:m].tobytes()
        return out

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        return self.merged([*(self.inner[b] for b in data[:-1]), self.last[data[-1]]])


class _Words(dict):
    """Word -> ids as little-endian bytes; emptied when it holds CACHE words."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, word: str) -> bytes:
        got = np.array(self.merges.word(word), "<u4").tobytes() if len(word) <= LONG else b"".join(LongWord(self.merges).all(word))
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[word] = got
        return got


    def warm(self, texts: Iterable[str]) -> None:
        """Encode the new words of these texts together, which is cheaper than one at a time."""
        new = {w for t in texts for w in pieces(normalised(t))} - self.keys()
        new = [w for w in new if len(w) <= LONG]
        if len(self) + len(new) > CACHE:
            self.clear()
        self.update(zip(new, self.merges.many(new)))


class LongWord:
    """The transducer inside one word: bytes in, stable tokens out, a buffer of bounded size."""

    def __init__(self, merges: Merges) -> None:
        self.m, self.data, self.width = merges, b"", {}

    def _span(self, token: int) -> int:
        if token not in self.width:
            t = self.m.bytes[token]
            self.width[token] = len(t) - (self.m.surface[token].endswith(self.m.suffix.encode()) and bool(self.m.suffix))
        return self.width[token]

    def feed(self, text: str) -> Iterator[bytes]:
        data = text.encode("utf-8", "replace")
        for at in range(0, len(data), CHUNK):
            self.data += data[at : at + CHUNK]
            while len(self.data) > self.m.lookahead + 1 + CHUNK:
                # the last symbol may yet get the suffix, and boundaries within the lookahead of the end may move
                safe, end, done = len(self.data) - 1 - self.m.lookahead, 0, []
                for t in self.m.merged([self.m.inner[b] for b in self.data]):
                    if end + self._span(t) > safe:
                        break
                    end += self._span(t)
                    done.append(t)
                if not end:
                    break
                yield np.array(done, "<u4").tobytes()
                self.data = self.data[end:]

    def end(self) -> bytes:
        data, self.data = self.data, b""
        return np.array(self.m.merged([*(self.m.inner[b] for b in data[:-1]), self.m.last[data[-1]]]), "<u4").tobytes() if data else b""

    def all(self, text: str) -> Iterator[bytes]:
        yield from self.feed(text)
        yield self.end()


@lru_cache(1)
def _joins_back() -> frozenset[str]:
    """Starters that NFC may compose with the character before them."""
    found = set()
    for i in range(0x110000):
        d = unicodedata.decomposition(chr(i))
        if d and d[0] != "<":
            found.add(chr(int(d.split()[-1], 16)))
    return frozenset(found | {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def normalised(text: str) -> str:
    """NFC, then lower case one character at a time (so no final-sigma rule). White space needs no replacing: every kind of it only ends words."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Encoder:
    """feed() text in pieces of any size and then end(); yields ids as little-endian bytes, whole tokens only, as soon as they are stable."""

    def __init__(self, merges: Merges) -> None:
        self.m, self.words = merges, _Words(merges)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.most = max((len(s) for s in merges.special), default=1)
        self.raw = ""  # not normalised yet
        self.text = ""  # normalised, not split yet
        self.inside: tuple[regex.Pattern, LongWord] | None = None  # the class of an unfinished long word, and its state

    def feed(self, text: str) -> Iterator[bytes]:
        for at in range(0, len(text), SEGMENT):
            self.raw += text[at : at + SEGMENT]
            yield from self._specials(False)

    def end(self) -> Iterator[bytes]:
        yield from self._specials(True)

    def _specials(self, last: bool) -> Iterator[bytes]:
        at = 0
        if self.special and any(s[:1] in self.raw for s in self.m.special):
            for found in self.special.finditer(self.raw):
                self.text += normalised(self.raw[at : found.start()])
                yield from self._split(True)
                yield np.array([self.m.special[found[0]]], "<u4").tobytes()
                at = found.end()
        cut = len(self.raw) if last else self._cut(at)
        self.text += normalised(self.raw[at:cut])
        self.raw = self.raw[cut:]
        yield from self._split(last)

    def _cut(self, least: int) -> int:
        """Where the raw text can be cut: no special string and no composition crosses."""
        for k in range(len(self.raw) - self.most, least, -1):
            c = self.raw[k]
            if c.isascii() or not unicodedata.combining(c) and c not in _joins_back():
                part = self.raw[max(least, k - self.most) : k]
                if not any(part.endswith(s[:n]) for s in self.m.special for n in range(1, len(s))):
                    return k
        return least

    def _split(self, last: bool) -> Iterator[bytes]:
        text = self.text
        if self.inside:
            kind, state = self.inside
            n = kind.match(text).end()
            yield from state.feed(text[:n])
            text = text[n:]
            if text or last:
                yield state.end()
                self.inside = None
        if last:
            yield b"".join(map(self.words.__getitem__, pieces(text)))
            self.text = ""
            return
        space = None
        for space in _SPACE.finditer(text, max(0, len(text) - 4 * LONG)):
            pass
        if space:
            yield b"".join(map(self.words.__getitem__, pieces(text[: space.end()])))
            text = text[space.end() :]
        elif text and not self.inside:
            at, done = 0, []
            for found in _SPLIT.finditer(text):
                if found.end() > len(text) - 3 and found[0][0] != "'" and len(found[0]) > LONG and found.end() == len(text):
                    self.inside = (_LETTERS if _LETTERS.match(found[0]).end() else _SIGNS, LongWord(self.m))
                    if done:
                        yield b"".join(done)
                    yield from self.inside[1].feed(found[0])
                    self.text = ""
                    return
                if found.end() > len(text) - 3:
                    break
                done.append(self.words[found[0]])
                at = found.end()
            if done:
                yield b"".join(done)
            text = text[at:]
        self.text = text


class Decoder:
    """feed() ids, end(): text, as far as the bytes so far determine it.

    surface=True gives the token strings joined by blanks, which is what a
    tokenizer file without a decoder prescribes; surface=False gives the text
    that the tokens stand for, a blank for each end of word.
    """

    def __init__(self, merges: Merges, surface: bool = True) -> None:
        self.table = merges.surface if surface else merges.bytes
        self.gap = b" " if surface else b""
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        table = self.table
        data = self.gap.join([table[i] for i in ids])
        if self.gap and self.begun and data:
            data = self.gap + data
        self.begun |= bool(data)
        return self.state.decode(data)

    def end(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(2)
def _loaded(path: str) -> tuple[Merges, Encoder]:
    m = Merges(path)
    return m, Encoder(m)


def encode(path: str, text: str | None) -> list[int]:
    """ids of a whole text (null: of the empty text)."""
    _, e = _loaded(path)
    return np.frombuffer(b"".join([*e.feed(text or ""), *e.end()]), "<u4").tolist()


def decode(path: str, ids: Iterable[int], surface: bool = True) -> str:
    d = Decoder(_loaded(path)[0], surface)
    return d.feed(ids) + d.end()


def digest(path: str, text: str | None) -> tuple[int, str, str]:
    """(number of ids, hash of the ids, hash of the decoded text); neither sequence is ever held whole."""
    m, e = _loaded(path)
    d, n, ids_hash, text_hash = Decoder(m), 0, hashlib.sha256(), hashlib.sha256()
    for step in (e.feed(text or ""), e.end()):
        for got in step:
            if got:
                ids_hash.update(got)
                ids = np.frombuffer(got, "<u4")
                n += len(ids)
                text_hash.update(d.feed(ids.tolist()).encode())
    text_hash.update(d.end().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def _warmed(path: str, texts: pa.Array) -> Iterator[str | None]:
    """The texts, about WARM characters at a time, their new words encoded beforehand; the longest texts are left to the stream."""
    group, size = [], 0
    for t in texts:
        t = t.as_py()
        group.append(t)
        size += len(t or "")
        if size >= WARM:
            _loaded(path)[1].words.warm(t for t in group if t and len(t) <= SEGMENT)
            yield from group
            group, size = [], 0
    _loaded(path)[1].words.warm(t for t in group if t and len(t) <= SEGMENT)
    yield from group


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row, in one pass without a shuffle.

    `path` must be readable on every executor. Null texts count as empty:
    0 tokens and the hashes of nothing. Null ids and repeated rows are kept,
    texts of any length are streamed, an empty table gives an empty result, and
    other columns are not read.
    """

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [digest(path, t) for t in _warmed(path, b.column(1))]
            n, i, t = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(t, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        _loaded(path)[1].words.clear()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(of, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row; cases as in token_digests()."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [encode(path, t) for t in _warmed(path, b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(of, "id long, ids array<int>")
