"""Token ids in flat binary files with 64-bit document offsets, to be memory-mapped.

A set of token files is a folder. For each shard it holds

  {name}.bin  ids one after another, unsigned little-endian, 2 or 4 bytes each
  {name}.off  for each document the offset of its first id in the shard, and the shard's number of ids last; unsigned 64-bit
  {name}.doc  for each document its id; signed 64-bit

and manifest.json names the shards in ascending order of document ids, with
each one's base: the number of ids, and of documents, in all shards before it.
The bases are the prefix sums of what the writing tasks counted. A document's
place in the whole is its shard's base and its offset.

Documents are encoded once and dealt, encoded, to shards by ranges of ids, and
one task per shard streams them into files. A task names its files
anew at each attempt, and only the attempts that Spark kept come into the
manifest, which is written last: lost executors leave unnamed files, no wrong ones.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.session import stored

#: Ids to a shard, about; least ids to a shard when there are few; documents of a reading task.
SHARD, LEAST, SLICE = 1 << 25, 1 << 18, 1 << 14
#: Bytes of ids that a task holds before it hands them on; characters that are encoded at once where a blank allows a cut.
HELD, PIECE = 2 << 20, 1 << 16
#: The pattern that byte-level tokenizers of this kind split texts by, and the bytes that stand for themselves in their files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = (range(33, 127), range(161, 173), range(174, 256))
#: Stands for a null document id.
NO_ID = -(1 << 63)


def _byte_level(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """(ids of byte strings, ids of special strings) of a byte-level tokenizer whose merges are in order of ids; None for any other."""
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    odd = [spec.get("normalizer"), *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
    odd += [a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")]
    if any(odd) or model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    plain = [b for r in PLAIN_BYTES for b in r]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {a["content"]: a["id"] for a in added}
    ids = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    if any(c not in byte_of for t in ids for c in t) or [ids.get(t) for t in merged] != list(range(256, 256 + len(merged))) or len(ids) != 256 + len(merged):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in ids.items()}, special


def pieces(text: str) -> Iterator[str]:
    """A text in parts that are encoded alike alone and together: cuts stand before single blanks between ASCII letters or digits."""
    plain = lambda c: c.isascii() and c.isalnum()
    at = 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE)
        while cut > 0 and not (plain(text[cut - 1]) and plain(text[cut + 1 : cut + 2])):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids with a tokenizer file, as the tokenizers library encodes without special tokens around, truncation and padding.

    Byte-level files are encoded by tiktoken from the same vocabulary, about
    four times as fast; other files, and stretches that its pattern cannot
    take (a million blanks), by the tokenizers library.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    slow = lambda t: np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as f:
        known = _byte_level(json.load(f))
    if known is None:
        return slow
    import tiktoken

    quick = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=known[0], special_tokens=known[1])

    def encode(text: str) -> np.ndarray:
        found = []
        for piece in pieces(text):
            try:
                found.append(quick.encode_to_numpy(piece, allowed_special="all"))
            except ValueError:
                found.append(slow(piece))
        return found[0] if len(found) == 1 else np.concatenate(found)

    return encode


def _place(where: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in where and where.startswith("file:"):
        where = "file://" + where[5:]
    return pa.fs.FileSystem.from_uri(where) if "://" in where else (pa.fs.LocalFileSystem(), where)


class _Far:
    """A flat file on a store that cannot be memory-mapped: slices are read by range."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, dtype: str, n: int) -> None:
        self.file, self.dtype, self.n = fs.open_input_file(path), np.dtype(dtype), n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, part: slice) -> np.ndarray:
        lo, hi, _ = part.indices(self.n)
        return np.frombuffer(self.file.read_at(max(0, hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), self.dtype)


def _mapped(where: str, name: str, dtype: str, n: int) -> np.ndarray | _Far:
    fs, folder = _place(where)
    if n and isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(f"{folder}/{name}", dtype, "r", shape=(n,))
    return _Far(fs, f"{folder}/{name}", dtype, n) if n else np.zeros(0, dtype)


def borders(rows: DataFrame, shard: int) -> list[int]:
    """Ids at which shards after the first begin, in ascending order: quantiles of the ids. An id that fills whole shards stands several times."""
    spark = rows.sparkSession
    about = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    guess = about.n + (about.bytes or 0) // 4
    shards = max(-(-guess // shard), min(spark.sparkContext.defaultParallelism, guess // LEAST))
    if shards < 2:
        return []
    return rows.agg(F.percentile_approx("id", [i / shards for i in range(1, shards)], 100 * shards)).first()[0] or []


def shard_of(first: list[int], key: int, row: int) -> int:
    """The shard of an id; rows of an id at which several shards begin are dealt to all of those by their number."""
    last = bisect.bisect_right(first, key)
    return last - row % (last - bisect.bisect_left(first, key) + 1)


def write(docs: DataFrame, tokenizer: str, where: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> None:
    """Encode whole texts, append the id `end` to each, and write them to a new folder `where` in ascending order of ids.

    Null and empty texts are the end id alone; null ids come first. Rows that
    repeat an id stand beside one another, in no certain order. Texts of
    any length are encoded whole. Other columns are not read. An empty table
    gives a manifest without shards. Ids take 2 bytes if the vocabulary and
    `end` fit, else 4.
    """
    from tokenizers import Tokenizer

    most = max([end, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()])
    dtype = "<u2" if most < 1 << 16 else "<u4"
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    first = borders(rows, shard)
    held: list = []

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(encoder(tokenizer))
        out: list = []
        row = size = 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "id", "n", "ids"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(held[0](text.as_py() or ""), end).astype(dtype)
                out.append((shard_of(first, key, row), key, len(ids), ids.tobytes()))
                row, size = row + 1, size + ids.nbytes
                if size > HELD:
                    yield batch()
                    out.clear()
                    size = 0
        if out:
            yield batch()

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, offset, docs_here = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, 0
        fs, folder = _place(where)
        files: list = []
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if not files:
                    fs.create_dir(folder)
                    files += [fs.open_output_stream(f"{folder}/{name}.{kind}") for kind in ("bin", "off", "doc")]
                n = b.column("n").to_numpy()
                ends = offset + np.cumsum(n)
                for data in b.column("ids"):
                    files[0].write(data.as_buffer())
                files[1].write((ends - n).astype("<u8").tobytes())
                files[2].write(b.column("id").to_numpy().astype("<i8").tobytes())
                offset, docs_here = int(ends[-1]), docs_here + len(n)
            if files:
                files[1].write(np.array([offset], "<u8").tobytes())
        finally:
            for f in files:
                f.close()
        if docs_here:
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "name": name, "docs": docs_here, "ids": offset}])

    table = rows.mapInArrow(encoded, "shard int, id long, n long, ids binary")
    dealt = table.repartitionById(len(first) + 1, "shard").sortWithinPartitions("id", "n", F.xxhash64("ids")).select("id", "n", "ids")
    counts = stored(dealt.mapInArrow(written, "shard long, name string, docs long, ids long")).orderBy("shard").collect()
    docs_base, ids_base = (np.concatenate([[0], np.cumsum([c[k] for c in counts])]).tolist() for k in ("docs", "ids"))
    listed = [{"name": c["name"], "docs": c.docs, "ids": c.ids, "docs_base": int(d), "ids_base": int(i)} for c, d, i in zip(counts, docs_base, ids_base)]
    fs, folder = _place(where)
    fs.create_dir(folder)
    with fs.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "end": end, "docs": int(docs_base[-1]), "ids": int(ids_base[-1]), "shards": listed}).encode())


def manifest(where: str) -> dict:
    """What manifest.json says."""
    fs, folder = _place(where)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


class TokenFiles:
    """Random access for a loader: documents by position, and windows of ids over all of them, from memory-mapped shards."""

    def __init__(self, where: str) -> None:
        self.where, self.about = where, manifest(where)
        self.shards = self.about["shards"]
        self._docs, self._ids = (np.array([s[k] for s in self.shards], np.int64) for k in ("docs_base", "ids_base"))
        self._open: dict = {}

    def __len__(self) -> int:
        return self.about["docs"]

    def _files(self, k: int) -> tuple:
        if k not in self._open:
            s = self.shards[k]
            self._open[k] = tuple(_mapped(self.where, f"{s['name']}.{kind}", t, n) for kind, t, n in (("bin", self.about["dtype"], s["ids"]), ("off", "<u8", s["docs"] + 1), ("doc", "<i8", s["docs"])))
        return self._open[k]

    def __getitem__(self, i: int) -> np.ndarray:
        """Ids of the i-th document, its end id included."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self._docs, i, "right")) - 1
        data, off, _ = self._files(k)
        lo, hi = (int(x) for x in off[i - int(self._docs[k]) : i - int(self._docs[k]) + 2])
        return data[lo:hi]

    def doc_id(self, i: int) -> int | None:
        """Id of the i-th document."""
        k = int(np.searchsorted(self._docs, i, "right")) - 1
        found = int(self._files(k)[2][i - int(self._docs[k]) : i - int(self._docs[k]) + 1][0])
        return None if found == NO_ID else found

    def window(self, start: int, n: int) -> np.ndarray:
        """n ids from position `start` of the whole, over shards' borders; fewer at the end."""
        stop, parts = min(start + n, self.about["ids"]), []
        while start < stop:
            k = int(np.searchsorted(self._ids, start, "right")) - 1
            lo = start - int(self._ids[k])
            part = self._files(k)[0][lo : min(self.shards[k]["ids"], lo + stop - start)]
            parts.append(part)
            start += len(part)
        return np.concatenate(parts) if parts else np.zeros(0, self.about["dtype"])


def _read(spark: SparkSession, where: str, column: str, schema: str, of: Callable[[np.ndarray], object], kind: pa.DataType) -> DataFrame:
    """(id, start, n_tokens, column): each document of the files with a value made of its ids; tasks map slices of shards."""
    about = manifest(where)
    names = "name string, docs long, ids long, ids_base long"
    shards = spark.createDataFrame([(s["name"], s["docs"], s["ids"], s["ids_base"]) for s in about["shards"]], names)
    slices = shards.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(SLICE).cast("long"))).alias("first"))
    tasks = max(1, min(20_000, sum(-(-s["docs"] // SLICE) for s in about["shards"])))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                last = min(s["docs"], s["first"] + SLICE)
                data = _mapped(where, f"{s['name']}.bin", about["dtype"], s["ids"])
                off = np.asarray(_mapped(where, f"{s['name']}.off", "<u8", s["docs"] + 1)[s["first"] : last + 1]).astype(np.int64)
                ids = np.asarray(_mapped(where, f"{s['name']}.doc", "<i8", s["docs"])[s["first"] : last])
                lo = 0
                while lo < len(ids):  # as many documents at once as hold SLICE * 16 ids, one at least
                    hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE * 16, "right")) - 1)
                    some = ids[lo:hi]
                    values = pa.array([of(data[off[i] : off[i + 1]]) for i in range(lo, hi)], kind)
                    yield pa.RecordBatch.from_arrays([pa.array(some, mask=some == NO_ID), pa.array(s["ids_base"] + off[lo:hi]), pa.array(np.diff(off[lo : hi + 1])), values], names=["id", "start", "n_tokens", column])
                    lo = hi

    return slices.repartition(tasks).mapInArrow(read, f"id long, start long, n_tokens long, {column} {schema}")


def crc32(ids: np.ndarray) -> int:
    """crc32 of ids as 32-bit little-endian integers, a million at a time."""
    crc = 0
    for lo in range(0, len(ids), 1 << 20):
        crc = zlib.crc32(np.asarray(ids[lo : lo + (1 << 20)]).astype("<u4").tobytes(), crc)
    return crc


def documents(spark: SparkSession, where: str) -> DataFrame:
    """(id, start, n_tokens, ids): all documents of token files; start counts the ids of all documents before it, the end id is among ids."""
    return _read(spark, where, "ids", "array<long>", lambda x: np.asarray(x).astype(np.int64), pa.list_(pa.int64()))


def digests(spark: SparkSession, where: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): the same with a checksum instead of the ids."""
    return _read(spark, where, "ids_crc32", "long", crc32, pa.int64())
