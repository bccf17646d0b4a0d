"""Token counts by offset mapping: whole documents are encoded once, and tokens are attributed to sections or fields by their spans.

A byte-level tokenizer's tokens tile the text, so their spans are running sums
of their lengths. Spans of sections are joined to them as intervals. A token
that crosses a boundary goes to one section by an explicit rule: the section of
its first byte (`first`), of its last (`last`), or the one with most of its
bytes, ties to the earlier (`most`).
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most")


@lru_cache(2)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of a rank file, and the byte length of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for t, i in ranks.items():
        size[i] = len(t)
    return tiktoken.Encoding("lexmere", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def attribute(ends: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens) that each of the sorted, disjoint spans [begin, end) gets; ends are the running ends of tokens that tile from 0.

    Tokens outside every span go to none.
    """
    starts = np.concatenate([ends[:1] * 0, ends[:-1]])
    at = np.clip(np.searchsorted(begin, starts, "right") - 1, 0, None)
    last = np.searchsorted(begin, ends - 1, "right") - 1
    covers = lambda s, lo, hi: np.minimum(hi, end[s]) - np.maximum(lo, begin[s])
    to = at
    if rule == "last":
        to = np.clip(last, 0, None)
    elif rule == "most" and (wide := last > at).any():
        to = at.copy()
        for i in np.flatnonzero(wide):  # these are few: a token is some bytes long
            of = np.arange(at[i], last[i] + 1)
            to[i] = of[np.argmax(covers(of, starts[i], ends[i]))]
    held = covers(to, starts, ends) > 0
    crossing = (starts < begin[to]) | (ends > end[to])
    return np.bincount(to[held], minlength=len(begin)), np.bincount(to[held & crossing], minlength=len(begin))


def lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of a text's lines, each with its line feed; a text that ends in one has no empty last line, the empty text has one line."""
    cuts = np.flatnonzero(data == 10) + 1
    edges = np.concatenate([[0], cuts[cuts < len(data)], [len(data)]])
    return edges[:-1], edges[1:]


def section_counts(docs: DataFrame, path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, begin, end, n_tokens, n_crossing): one row per line of each text, spans in characters; a text's n_tokens add up to its tokens.

    `path` must be readable on every executor. Null and empty texts have one
    section of 0 tokens. Null ids and repeated rows stay, texts of any length
    are encoded whole, an empty table gives an empty result, other columns are
    not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    types = {"id": pa.int64(), "section": pa.int32(), "begin": pa.int64(), "end": pa.int64(), "n_tokens": pa.int64(), "n_crossing": pa.int64()}

    def one(text: str) -> list[np.ndarray]:
        enc, size = encoding(path, pattern)
        raw = text.encode("utf-8", "replace")
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(size[enc.encode_ordinary(raw.decode())])
        begin, end = lines(data)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        n, crossing = attribute(ends, begin, end, rule) if len(ends) else (begin * 0, begin * 0)
        return [np.arange(len(begin)), chars[begin], chars[end], n, crossing]

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found = [one(t or "") for t in part.column(1).to_pylist()]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c), t) for c, t in zip(zip(*found), [*types.values()][1:]))], names=[*types])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(of, "id long, section int, begin long, end long, n_tokens long, n_crossing long")


def field_counts(docs: DataFrame, path: str, pattern: str, fields: list[str], rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """(id, field, n_tokens): the fields are joined by line feeds, encoded once, and tokens attributed to them; the joining line feeds belong to the field before. Null fields are empty."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoding(path, pattern)
        for b in batches:
            for i in range(b.num_rows):
                raw = [((c[i].as_py() or "") + "\n" * (k < len(fields))).encode("utf-8", "replace") for k, c in enumerate(b.columns[1:], 1)]
                ends = np.cumsum(size[enc.encode_ordinary(b"".join(raw).decode())])
                edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
                n = attribute(ends, edges[:-1], edges[1:], rule)[0] if len(ends) else np.zeros(len(fields), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(fields))), pa.array(fields), pa.array(n, pa.int64())], names=["id", "field", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string").alias(f"_{k}") for k, c in enumerate(fields)])
    return rows.mapInArrow(of, "id long, field string, n_tokens long")
