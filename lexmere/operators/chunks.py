"""Texts into sentence-aligned, size-balanced chunks with their places in the text and on pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmere.session import stored

#: Characters of a chunk, least share of a last one, and the share, in hundredths, at which a single group is split again.
TARGET, LEAST_SHARE, SPLIT_PERCENT = 262_144, 0.5, 51

#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("Dr", "Dra", "Sr", "Sra", "Lic", "Ing", "Art", "art", "No", "núm", "pág", "etc", "S.L", "S.A", "Inc", "Mr", "Mrs", "vs", "p.ej")

#: White space between sentences.
WHITE = " \t\n\x0b\f\r"
#: Abbreviations that a pattern may hold at most: each end of a sentence is looked at for each of them.
MOST_ABBREVIATIONS = 500


def _kept(raw: Column) -> Column:
    """Without the white space at the end."""
    return F.rtrim(raw, F.lit(WHITE))


def _sentence(abbreviations: Sequence[str]) -> str:
    """Pattern of a sentence with the white space after it. It never goes back, so its time is linear in the text."""
    if len(abbreviations) > MOST_ABBREVIATIONS:
        raise ValueError(f"at most {MOST_ABBREVIATIONS} abbreviations, not {len(abbreviations)}")
    inside = r"[^.!?]++|[.!?]++(?![ \t\n\x0B\f\r]|\z)"
    if abbreviations:
        inside += rf"|[.!?]++(?<=(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(re.sub(r'([^\w])', r'\\\1', a) for a in abbreviations)})\.)"
    return rf"((?s).(?:{inside})*+[.!?]*+[ \t\n\x0B\f\r]*+)"


def sentence_array(text: Column, abbreviations: Sequence[str] = ABBREVIATIONS) -> Column:
    """Sentences with the white space after them; one after another they are the text.

    A sentence ends at stops before white space, or with the text, but not at
    an abbreviation's stop. A text's first character never ends a sentence.
    Empty texts have none; null gives null.
    """
    return F.regexp_extract_all(text, F.lit(_sentence(abbreviations)), F.lit(1))


def sentences(docs: DataFrame, abbreviations: Sequence[str] = ABBREVIATIONS) -> DataFrame:
    """(document_id, sentence_no, begin, end, text) with spans in characters, without the white space after a sentence.

    Sentences become rows before their places are summed, so a text of any
    number of sentences takes linear time; sentences of white space alone are
    left out.
    """
    s = F.posexplode_outer(sentence_array(F.coalesce("text_content", F.lit("")), abbreviations))
    rows = docs.select(F.col("id").alias("document_id"), s.alias("sentence_no", "raw")).where("raw is not null")
    before = F.sum(F.length("raw")).over(W.partitionBy("document_id").orderBy("sentence_no").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("begin", F.coalesce(before, F.lit(0)).cast("int")).withColumn("text", _kept(F.col("raw")))
    return rows.select("document_id", "sentence_no", "begin", (F.col("begin") + F.length("text")).alias("end"), "text").where("text <> ''")


def _filled(upto: np.ndarray, target: int) -> list[int]:
    """First positions of all groups: from each group's first the next is one search in the prefix sums. A small last group joins the one before."""
    firsts = [0]
    while True:
        first = firsts[-1]
        nxt = int(np.searchsorted(upto, upto[first] + target, "right")) - 1
        if upto[min(nxt, len(upto) - 1)] == upto[first]:
            nxt += 1  # a size over the target stands in a group of its own, with sizes of 0 before it
        if nxt >= len(upto) - 1:
            break
        firsts.append(nxt)
    return firsts[:-1] if len(firsts) > 1 and upto[-1] - upto[firsts[-1]] < LEAST_SHARE * target else firsts


def grouped(upto: np.ndarray, target: int) -> list[int]:
    """E8 for prefix sums of sizes, 0 first."""
    total = int(upto[-1])
    if total <= target:
        return [0]
    firsts = _filled(upto, target)
    return _filled(upto, -(-total * SPLIT_PERCENT // 100)) if len(firsts) == 1 and len(upto) > 2 else firsts


def _groups(target: int) -> Callable[[Column, Column], Column]:
    """(sizes, widths) -> [(first position, widths before it)] of all groups."""

    def of(sizes: pa.Array, widths: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False))])
        n, wide = (pc.fill_null(x.flatten(), 0).to_numpy(zero_copy_only=False) for x in (sizes, widths))
        out = []
        for lo, hi in zip(ends, ends[1:]):
            upto, at = (np.concatenate([[0], np.cumsum(x[lo:hi], dtype=np.int64)]) for x in (n, wide))
            out.append([{"first": i, "at": int(at[i])} for i in grouped(upto, target)])
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("at", pa.int64())])))

    return F.arrow_udf(of, "array<struct<first:int,at:bigint>>")


def group_breaks(sizes: str | Column, target: int = TARGET) -> Column:
    """First positions of all groups of an array column of sizes.

    All in one group if the total is within the target; if filling to the
    target gives one group all the same and there are several sentences, fill
    to ceil(0.51 * total) instead. Null and empty arrays are one group, null
    sizes are 0.

    A higher-order fold copies its state at every element, so one that gathers
    breaks takes quadratic time. Here prefix sums are searched once for each
    group, in Arrow batches: only sizes go to Python, never texts.
    """
    sizes = F.col(sizes) if isinstance(sizes, str) else sizes
    return F.transform(_groups(target)(sizes, sizes), lambda g: g["first"])


def page_at(offset: str, offsets: str = "page_offsets") -> Column:
    """The page, from 1, whose stretch of page_offsets holds an offset; past the end: the last page."""
    return F.expr(f"greatest(1, least(size(filter({offsets}, o -> o <= {offset})), size({offsets}) - 1))")


def chunks(docs: DataFrame, target: int = TARGET, abbreviations: Sequence[str] = ABBREVIATIONS, carried: Sequence[str] = ()) -> DataFrame:
    """(id, text_content, page_offsets?) -> (document_id, chunk_index, text, offset_start, offset_end, page_start, page_end), and the document's `carried` columns.

    A text within the target is one chunk; null and empty texts are one empty
    chunk on page 1. In longer texts white space before the first sentence and
    between sentences counts for no group, and chunks neither begin nor end
    with it. A long text of white space alone is one empty chunk at its end.

    Sentences are found once; each chunk's text is made of its own sentences,
    and no row carries the whole text: time is linear in the text.
    """
    text = F.coalesce("text_content", F.lit(""))
    pages = F.when(F.size("page_offsets") > 1, F.col("page_offsets")) if "page_offsets" in docs.columns else F.lit(None).cast("array<int>")
    one = lambda t, begin: F.array(F.struct(F.lit(0).alias("chunk_index"), t.alias("text"), begin.cast("int").alias("offset_start")))

    d = docs.select(F.col("id").alias("document_id"), text.alias("t"), F.coalesce(pages, F.array(F.lit(0), F.length(text))).alias("page_offsets"), *carried)
    whole, lead = F.length("t") <= target, F.length("t") - F.length(F.ltrim("t", F.lit(WHITE)))
    d = d.select("document_id", "page_offsets", *carried, F.when(whole, F.lit(None)).otherwise(lead).alias("lead"), F.when(whole, F.array("t")).otherwise(sentence_array(F.ltrim("t", F.lit(WHITE)), abbreviations)).alias("s"))
    # a text of white space alone has no sentence: one empty chunk
    # only sizes go to the fill; a text of white space alone has no sentence, and is one empty chunk
    d = d.withColumn("groups", _groups(target)(F.transform("s", lambda x: F.length(_kept(x))), F.transform("s", F.length)))
    last = F.size("groups") - 1
    held = lambda g, k: F.slice("s", g["first"] + 1, F.when(k < last, F.get("groups", k + 1)["first"]).otherwise(F.size("s")) - g["first"])
    built = F.transform("groups", lambda g, k: F.struct(k.alias("chunk_index"), F.array_join(held(g, k), "").alias("raw"), g["at"].alias("at")))
    # outer: for the inner generator Catalyst would copy all that stands behind the array into a filter
    d = d.select("document_id", "page_offsets", *carried, "lead", F.explode_outer(built).alias("c"))
    d = d.select("document_id", "page_offsets", *carried, "c.chunk_index", F.when(F.col("lead").isNull(), F.col("c.raw")).otherwise(_kept(F.col("c.raw"))).alias("text"), (F.coalesce("lead", F.lit(0)) + F.col("c.at")).cast("int").alias("offset_start"))
    rows = d.withColumn("offset_end", F.col("offset_start") + F.length("text")).withColumn("last", F.greatest(F.col("offset_end") - 1, F.lit(0)))
    return rows.select("document_id", "chunk_index", "text", "offset_start", "offset_end", page_at("offset_start").alias("page_start"), page_at("last").alias("page_end"), *carried)


def batch_numbers(sizes: np.ndarray, most: int, filled: int = 0, number: int = 0) -> tuple[np.ndarray, int, int]:
    """(batch of each size, tokens in the last batch, its number), going on from a batch `number` that holds `filled` tokens already. Each batch's end is one search in the prefix sums."""
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out, i = np.empty(len(sizes), np.int64), 0
    while i < len(sizes):
        j = int(np.searchsorted(upto, upto[i] + most - filled, "right")) - 1
        if j <= i and filled:
            filled, number = 0, number + 1
            continue
        j = max(j, i + 1)  # a row over the limit is a batch of its own
        out[i:j], filled = number, filled + int(upto[j] - upto[i])
        i = j
    return out, filled, number


def token_batches(rows: DataFrame, key: str, order: str, text: str, most: int = 240_000) -> DataFrame:
    """(key, order, batch): rows in order, a new batch where an estimate of a quarter of the characters and 14 more would pass the limit.

    Rows are dealt by key and sorted, and stream through with the open batch's
    size as the only state: time is linear, and memory an Arrow batch, in keys
    of any number of rows. One key's rows pass one task, as each batch depends
    on all before it. Rows of one key and order stand by size; null keys are
    one key. Texts do not travel, only their sizes.
    """
    size = F.greatest(F.lit(1), F.floor((F.length(F.coalesce(text, F.lit(""))) + 14) / 4)).cast("long").alias("n")
    named = rows.select(F.col(key).alias("key"), F.col(order).alias("at"), size)
    kinds = [named.schema[c].dataType.simpleString() for c in ("key", "at")]

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filled, number = (), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            runs, sizes, out, at = pc.run_end_encode(b.column(0)), b.column(2).to_numpy(), [], 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if (value,) != now:
                    now, filled, number = (value,), 0, 0
                found, filled, number = batch_numbers(sizes[at:end], most, filled, number)
                out.append(found)
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(out))], names=["key", "at", "batch"])

    found = named.repartition("key").sortWithinPartitions("key", "at", "n").mapInArrow(numbered, f"key {kinds[0]}, at {kinds[1]}, batch long")
    return found.select(F.col("key").alias(key), F.col("at").alias(order), "batch")


def learned_abbreviations(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """(word, with_stop, without_stop, score): words of the corpus that a stop follows too often to be sentence ends.

    Dunning's log-likelihood that a word and a stop belong together, against
    that they meet by chance, made smaller for long words and for each time the
    word stands without a stop, greater for stops inside it. All words of all
    documents are counted in one aggregation. `abbreviations` gives the highest
    as a list for `sentences` and `chunks`.
    """
    tokens = docs.select(F.explode(F.regexp_extract_all("text_content", F.lit(r"(\p{L}+(?:\.\p{L}+)*\.?)"), F.lit(1))).alias("t"))
    stop = F.col("t").endswith(".")
    n = tokens.groupBy("t").agg(F.count("*").alias("n"))
    words = stored(n.groupBy(F.rtrim("t", F.lit(".")).alias("word")).agg(F.sum(F.when(stop, F.col("n")).otherwise(0)).alias("with_stop"), F.sum(F.when(stop, 0).otherwise(F.col("n"))).alias("without_stop")))
    total = words.agg(F.sum("with_stop").alias("s"), F.sum(F.col("with_stop") + F.col("without_stop")).alias("n")).first()
    if not total.s or total.s == total.n:
        return words.limit(0).withColumn("score", F.lit(0.0))
    share = total.s / total.n
    a, b = F.col("with_stop").cast("double"), F.col("without_stop").cast("double")
    likelihood = -2 * (a * F.log(F.lit(share / 0.99)) + b * F.log(F.lit((1 - share) / 0.01)))
    dots = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.length("word") - dots).cast("double")
    score = likelihood * F.exp(-letters) * (dots + 1) * F.pow(letters, -b)
    return words.withColumn("score", F.round(score, 6)).where((F.col("with_stop") > 0) & (F.col("score") >= least))


def abbreviations(learned: DataFrame) -> tuple[str, ...]:
    """The fixed abbreviations and the highest learned ones, as many as a pattern may hold."""
    more = learned.where(~F.col("word").isin(*ABBREVIATIONS)).orderBy(F.desc("score"), "word").limit(MOST_ABBREVIATIONS - len(ABBREVIATIONS)).collect()
    return (*ABBREVIATIONS, *[r.word for r in more])
