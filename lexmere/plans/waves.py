"""Events extracted by a user's own function, wave by wave, with what earlier chunks gave in the prompt.

A chunk's prompt holds events of the document's earlier chunks, so chunk k of
a document waits for its chunks before k, and for no other document. Wave r
runs the extractor on all chunks of index r over the whole corpus. Between
waves each document that has a further chunk keeps its latest few events and
nothing else, so a wave costs what its own chunks cost: the long documents'
tail is a tail of small jobs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmere.operators import chunks as C
from lexmere.operators import store as T
from lexmere.session import exists, shared_dir, stored

#: (document_id, chunk_index, text, prior, prompt, provider_id, model, llm_mode) -> (document_id, chunk_index, response_text) and, if known, USAGE.
Extractor = Callable[[DataFrame], DataFrame]
#: Counters that an extractor may return.
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")
#: Events of earlier chunks that a prompt holds.
PRIOR = 10


def calling(ask: Callable[[str], str], attempts: int = 3) -> Extractor:
    """An extractor out of a function from prompt to response, called in the tasks that hold the chunks.

    A call that fails `attempts` times is a refusal: its response is empty and
    the last error stands in `error`. Rows pass in Arrow batches, one call after
    another in a task; partitions set how many calls run at once.
    """

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for document, chunk, prompt in zip(*(b.column(i).to_pylist() for i in range(3))):
                said, error = None, None
                for _ in range(attempts):
                    try:
                        said, error = ask(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever the user's function raises is a refusal of this chunk alone
                        error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([document], b.column(0).type), pa.array([chunk], pa.int32()), pa.array([said], pa.string()), pa.array([error], pa.string())], names=["document_id", "chunk_index", "response_text", "error"])

    def extract(wave: DataFrame) -> DataFrame:
        kind = wave.schema["document_id"].dataType.simpleString()
        return wave.select("document_id", F.col("chunk_index").cast("int"), "prompt").mapInArrow(asked, f"document_id {kind}, chunk_index int, response_text string, error string")

    return extract


def answers(responses: DataFrame) -> Extractor:
    """An extractor that looks responses up in a table (document_id, chunk_index, response_text).

    Responses are made once and laid out in folders by chunk_index; a wave has one chunk_index, so it reads its own folder alone.
    """
    kept = stored(responses.withColumn("chunk_index", F.col("chunk_index").cast("int")), by=["chunk_index"])
    return lambda wave: wave.select("document_id", "chunk_index").join(kept, ["document_id", "chunk_index"])


def _latest(events: DataFrame, most: int) -> DataFrame:
    """Each document's latest events, in order of E2."""
    rank = F.row_number().over(W.partitionBy("document_id").orderBy(F.col("time_start").desc_nulls_last(), "id"))
    return events.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def _answered(wave: DataFrame, found: DataFrame) -> DataFrame:
    """The wave's chunks with what the extractor gave them: one row for each chunk, rows of other chunks ignored; of several for one chunk the least response counts."""
    has = lambda c: F.col(c).cast("long") if c in found.columns else F.lit(None).cast("long")
    error = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
    got = found.select("document_id", F.col("chunk_index").cast("int"), F.struct(F.col("response_text").isNull().alias("none"), "response_text", error.alias("error"), *[has(c).alias(c) for c in USAGE]).alias("a"))
    one = got.groupBy("document_id", "chunk_index").agg(F.min("a").alias("a"))
    return wave.select("document_id", "chunk_index", "prompt").join(one, ["document_id", "chunk_index"], "left").select("document_id", "chunk_index", "prompt", "a.response_text", "a.error", *[f"a.{c}" for c in USAGE])


def _kept(spark: SparkSession, where: str, r: int, made: Callable[[], DataFrame]) -> DataFrame:
    """Wave r's calls as a table under `where`; a wave that is there whole is read, not asked again."""
    path = f"{where}/wave-{r:06d}"
    if not exists(spark, f"{path}/_SUCCESS"):
        made().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run(documents: DataFrame, extractor: Extractor, target: int = C.TARGET, prior: int = PRIOR, where: str | None = None) -> dict[str, DataFrame]:
    """(id, text_content, provider_id, model, llm_mode) -> the tables of a corpus run (P12), and `calls`: (document_id, chunk_index, prompt, response_text, error, counters) of each chunk.

    Chunks without a response, and responses that hold no JSON, are refused:
    they have no events, and later chunks go on. With `where`, a folder all
    executors share, a run that was stopped goes on after its last whole wave;
    documents and target must be the same. Empty documents are one empty chunk
    each and are asked like others.
    """
    spark = documents.sparkSession
    settings = ["provider_id", "model", "llm_mode"]
    asked = stored(C.chunks(documents, target, carried=settings).withColumn("chunk_index", F.col("chunk_index").cast("int")), by=["chunk_index"])
    chunks = asked.drop(*settings)
    last = chunks.agg(F.max("chunk_index")).first()[0]
    where = where or f"{shared_dir(spark)}/waves-{uuid.uuid4().hex}"
    known, waves = None, (last if last is not None else -1) + 1
    for r in range(waves):
        # by the table's folders, no other wave's texts are read
        ready = asked.where(F.col("chunk_index") == r).select("document_id", "chunk_index", "text", *settings)
        ready = ready.join(T.prior_lists(known), "document_id", "left") if known is not None else ready.withColumn("prior", F.lit(None).cast("string"))
        wave = ready.withColumn("prompt", T.prompt_text(F.col("prior"), F.col("text")))
        answered = _kept(spark, where, r, lambda: _answered(wave, extractor(wave)))  # noqa: B023  made at once
        if r < last:
            new = T.event_heads(T.parsed(answered))
            on = chunks.where(F.col("chunk_index") == r + 1).select("document_id").distinct()
            before = known.select(*new.columns).unionByName(new) if known is not None else new
            known = stored(_latest(before.join(on, "document_id", "left_semi"), prior))
    calls = spark.read.parquet(*[f"{where}/wave-{r:06d}" for r in range(waves)]) if waves else _answered(chunks.withColumn("prompt", F.col("text")), T.no_responses(chunks))
    parsed = stored(T.parsed(calls))
    events = stored(T.event_rows(parsed, documents))
    return {"calls": calls} | T.run_tables(documents, chunks, parsed, events)
