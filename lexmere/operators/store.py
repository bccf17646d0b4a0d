"""Stored extraction responses into event tables, and replacement of what a chunk had before."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmere.functions import scalars as S
from lexmere.operators.refs import resolved
from lexmere.session import stored

EVENT = (
    "title string, description string, time_start string, time_end string, time_precision string, location struct<name string, location_type string>,"
    " participants array<struct<name string, role string>>, references array<struct<reference_type string, verbatim_text string, span_start string, span_end string>>"
)
KINDS = ("location", "participant", "time", "description")


def parsed(responses: DataFrame) -> DataFrame:
    """(document_id, chunk_index, response_text) with refused, reason and events; a bare list of events counts as one."""
    text = F.trim(F.coalesce("response_text", F.lit("")))
    whole = F.from_json(text, f"events array<struct<{EVENT}>>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bare = F.from_json(F.concat(F.lit('{"events":'), text, F.lit("}")), f"events array<struct<{EVENT}>>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    got = F.when(text.startswith("["), bare).otherwise(whole)
    out = responses.withColumn("_got", got)
    refused = (text == "") | F.col("_got").isNull() | F.col("_got._bad").isNotNull()
    reason = F.when(text == "", "empty response").when(refused, F.concat(F.lit("no JSON: "), text))
    none = F.array().cast(f"array<struct<{EVENT}>>")
    return out.select("document_id", "chunk_index", refused.alias("refused"), S.shortened(reason, 200).alias("reason"), F.when(refused, none).otherwise(F.coalesce("_got.events", none)).alias("events"))


def refusal_rate(parsed_rows: DataFrame, most: float = 0.05) -> DataFrame:
    """D17."""
    rate = F.avg(F.col("refused").cast("int"))
    return parsed_rows.agg(F.round(rate, 6).alias("rate"), (rate < most).alias("within"))


def usage_rows(usage: DataFrame) -> DataFrame:
    """Rows whose three counters are all positive."""
    return usage.where("prompt_tokens > 0 and completion_tokens > 0 and total_tokens > 0")


def _event_id() -> Column:
    return S.key_id(F.col("document_id"), F.col("chunk_index"), F.col("n")).alias("id")


def _each_event(parsed_rows: DataFrame) -> DataFrame:
    # outer: for the inner generator Catalyst would copy the parsing of events into a filter
    return parsed_rows.select("document_id", "chunk_index", F.posexplode_outer("events").alias("n", "e")).where("n is not null")


def event_rows(parsed_rows: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per event, with its children still nested, a deterministic id and the document's provider and tracking model."""
    stamp = documents.select(F.col("id").alias("document_id"), "provider_id", S.tracking_model(F.col("model"), F.col("llm_mode")).alias("model"))
    return _each_event(parsed_rows).join(stamp, "document_id", "left").select(
        _event_id(), "document_id", "chunk_index", F.coalesce("e.title", F.lit("")).alias("title"), F.coalesce("e.description", F.lit("")).alias("description"),
        S.parsed_date(F.col("e.time_start")).alias("time_start"), S.parsed_date(F.col("e.time_end")).alias("time_end"), "e.time_precision", "provider_id", "model", "e.location", "e.participants", "e.references",
    )


def event_heads(parsed_rows: DataFrame) -> DataFrame:
    """(document_id, id, title, time_start) of event_rows(): what prompts need, without the documents."""
    return _each_event(parsed_rows).select("document_id", _event_id(), F.coalesce("e.title", F.lit("")).alias("title"), S.parsed_date(F.col("e.time_start")).alias("time_start"))


def location_rows(events: DataFrame) -> DataFrame:
    """Events that name a place."""
    return events.where(F.coalesce("location.name", F.lit("")) != "").select(F.col("id").alias("event_id"), "location.name", "location.location_type")


def participant_rows(events: DataFrame) -> DataFrame:
    """Named participants; the role defaults to subject, confidence to 1."""
    p = events.select(F.col("id").alias("event_id"), F.posexplode_outer("participants").alias("n", "p"))
    return p.where(F.coalesce(F.trim("p.name"), F.lit("")) != "").select("event_id", "n", F.trim("p.name").alias("name"), F.coalesce(F.when(F.col("p.role") != "", F.col("p.role")), F.lit("subject")).alias("role"), F.lit(1.0).alias("confidence"))


def reference_rows(events: DataFrame) -> DataFrame:
    """References of the four kinds; missing texts and spans are empty and 0."""
    r = events.select(F.col("id").alias("event_id"), "document_id", "chunk_index", F.posexplode_outer("references").alias("n", "r"))
    return r.where(F.col("r.reference_type").isin(*KINDS)).select("event_id", "document_id", "chunk_index", "n", "r.reference_type", F.coalesce("r.verbatim_text", F.lit("")).alias("verbatim_text"), S.whole_number(F.col("r.span_start")).alias("span_start"), S.whole_number(F.col("r.span_end")).alias("span_end"))


def edges(events: DataFrame) -> DataFrame:
    return events.select(F.col("id").alias("event_id"), "document_id", "chunk_index")


def stored_counts(parsed_rows: DataFrame) -> DataFrame:
    """Events and references stored per chunk; chunks without events have 0."""
    kept = F.expr(f"aggregate(transform(events, e -> size(filter(coalesce(e.references, array()), r -> r.reference_type in {KINDS}))), 0L, (a, n) -> a + n)")
    return parsed_rows.select("document_id", "chunk_index", F.size("events").cast("long").alias("events_stored"), kept.alias("references_stored"))


def replaced(existing: DataFrame, new: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys are not touched, and the new ones; a touched key without new rows is emptied."""
    kept = existing.join(touched.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns))


def upserted(old: DataFrame, new: DataFrame, key: str, changing: list[str], arrival: str | None = None) -> DataFrame:
    """Rows of both; where a key is in both, only `changing` columns take the new value. Of new rows with one key the latest counts."""
    if arrival:
        latest = F.row_number().over(W.partitionBy(key).orderBy(F.col(arrival).desc()))
        new = new.withColumn("_n", latest).where("_n = 1").drop("_n")
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.when(F.col(f"o.{key}").isNull(), F.col(f"n.{c}")).when(F.col(f"n.{key}").isNull() | F.lit(c not in changing), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[pick(c) for c in old.columns if c != key])


def log_rows(log: DataFrame, most: int = 100) -> DataFrame:
    """At most 100 rows per document, first come; numbered per step from 0; ids from the number."""
    per = W.partitionBy("document_id")
    first = log.withColumn("_n", F.row_number().over(per.orderBy("arrival", "step_name"))).where(F.col("_n") <= most).drop("_n")
    seq = (F.row_number().over(W.partitionBy("document_id", "step_name").orderBy("arrival")) - 1).cast("long")
    level = F.when(F.col("severity").isin("info", "warning", "error"), F.col("severity")).otherwise("info")
    return first.withColumn("seq", seq).withColumn("severity", level).withColumn("id", S.log_id(F.col("document_id"), F.col("step_name"), F.col("seq")))


def latest_status(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest change of each document sets its status and message; a null message clears it."""
    last = changes.groupBy("document_id").agg(F.max_by(F.struct("status", "error_message"), "ts").alias("c"))
    d = documents.join(last, documents.id == last.document_id, "left")
    return d.select("id", F.coalesce("c.status", documents.status).alias("status"), F.col("c.error_message").alias("error_message"))


def without_documents(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """K5: rows of a table whose document (or event) is not among the deleted."""
    return table.join(gone.select(F.col(gone.columns[0]).alias(key)), key, "left_anti")


def without_provider(providers: DataFrame, colors: DataFrame, documents: DataFrame, provider: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K6: provider, its colour and the documents' link go; a default provider stays, and so does everything with it."""
    gone = providers.where((F.col("id") == provider) & ~F.col("is_default")).select(F.col("id").alias("provider_id"))
    linked = documents.join(F.broadcast(gone.withColumn("_gone", F.lit(True))), "provider_id", "left")
    unlinked = linked.withColumn("provider_id", F.when(F.col("_gone").isNull(), F.col("provider_id"))).select(*documents.columns)
    return providers.join(gone, providers.id == gone.provider_id, "left_anti"), colors.join(gone, "provider_id", "left_anti"), unlinked


def assigned_colors(providers: DataFrame, colors: DataFrame, size: int = 20) -> DataFrame:
    """Providers without a colour take the least free ones in order of creation; when none is free, the count of colours modulo their number. Providers are few: their order is one task's."""
    free = providers.sparkSession.range(size).select(F.col("id").cast("int").alias("color_index")).join(colors.select("color_index").distinct(), "color_index", "left_anti")
    free = free.withColumn("k", F.row_number().over(W.orderBy("color_index")))
    new = providers.join(colors, providers.id == colors.provider_id, "left_anti").withColumn("k", F.row_number().over(W.orderBy("created_at", "id")))
    used = colors.agg(F.count("*").alias("used"))
    return new.join(F.broadcast(free), "k", "left").join(F.broadcast(used), F.lit(True)).select(F.col("id").alias("provider_id"), F.coalesce("color_index", ((F.col("used") + F.col("k") - 1) % size).cast("int")).alias("color_index"))


def geocoded(locations: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Rows without coordinates take those of their name; located rows and unknown names stay. Repeated names: the least coordinates."""
    g = gazetteer.groupBy("name").agg(F.min(F.struct("lat", "lon")).alias("_g"))
    fill = lambda c: F.when(F.col("lat").isNull(), F.col(f"_g.{c}")).otherwise(F.col(c)).alias(c)
    return locations.join(g, "name", "left").select("id", "event_id", "name", fill("lat"), fill("lon"))


def looked_up(locations: DataFrame, cache: DataFrame, geocode: Callable[[str], tuple[float, float] | None], most: int = 100) -> DataFrame:
    """(name, lat, lon): the cache, and with it what a user's function says of up to `most` unlocated names that it does not have.

    Names are asked once each, in order of name, in tasks; a name without a
    place is kept with nulls and not asked again. A name on which the function
    raises stays out, so that the next run asks again. Null and blank names are
    not asked. `geocoded` then fills the locations.
    """
    kinds = "name string, lat double, lon double"

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                try:
                    at = geocode(name)
                    rows.append((name, *(map(float, at) if at is not None else (None, None))))
                except Exception:  # noqa: BLE001  what the user's function raises concerns this name and this run alone
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.float64(), pa.float64()))], names=["name", "lat", "lon"])

    names = locations.where("lat is null and trim(name) <> ''").select("name").distinct().join(cache.select("name"), "name", "left_anti")
    found = names.orderBy("name").limit(most).repartition(8, "name").mapInArrow(asked, kinds)
    # asked once, whatever reads the table after
    return cache.select("name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).unionByName(stored(found))


def prior_events(events: DataFrame, most: int = 10) -> DataFrame:
    """Each document's latest events."""
    rank = F.row_number().over(W.partitionBy("document_id").orderBy(F.col("time_start").desc_nulls_last(), "id"))
    return events.withColumn("rank", rank).where(F.col("rank") <= most).select("document_id", F.col("rank").cast("long").alias("rank"), "id", "title", "description", S.iso(F.col("time_start")).alias("time_start"))


def prior_per_chunk(chunks: DataFrame, events: DataFrame, most: int = 10) -> DataFrame:
    """For each chunk the latest events of the document's earlier chunks.

    Each (document, chunk) of events is cut to its own latest first, so a chunk meets no more than that many rows of each earlier one.
    """
    order = [F.col("time_start").desc_nulls_last(), F.col("id")]
    top = events.withColumn("_r", F.row_number().over(W.partitionBy("document_id", "chunk_index").orderBy(*order))).where(F.col("_r") <= most)
    e = top.select("document_id", F.col("chunk_index").alias("_of"), "id", "title", "time_start")
    met = chunks.select("document_id", "chunk_index").join(e, "document_id").where("_of < chunk_index")
    rank = F.row_number().over(W.partitionBy("document_id", "chunk_index").orderBy(*order))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select("document_id", "chunk_index", F.col("rank").cast("long").alias("rank"), "id", "title")


def prior_lists(ranked: DataFrame) -> DataFrame:
    """(document_id, rank, id, title) -> (document_id, prior): each document's events as JSON, in order of rank."""
    return ranked.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "id", "title")))).alias("prior"))


def prompt_text(prior: Column, text: Column) -> Column:
    """U4: the prior events, if any, what is asked for, and the chunk."""
    ask = F.lit('Return JSON {"events": [...]} with title, description, dates, location, participants and references quoted word for word.')
    return F.concat_ws("\n\n", F.concat(F.lit("Events so far: "), prior), ask, text)


def prompts(chunks: DataFrame, priors: DataFrame) -> DataFrame:
    """U4: (document_id, chunk_index, prompt) from (document_id, chunk_index, rank, id, title) of prior events."""
    p = priors.groupBy("document_id", "chunk_index").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "id", "title")))).alias("prior"))
    return chunks.join(p, ["document_id", "chunk_index"], "left").select("document_id", "chunk_index", prompt_text(F.col("prior"), F.col("text")).alias("prompt"))


def run_summary(documents: DataFrame, parsed_rows: DataFrame, resolved_refs: DataFrame) -> DataFrame:
    """(document_id, status, event_count, resolved, total) of every document of a run."""
    counts = stored_counts(parsed_rows).groupBy("document_id").agg(F.sum("events_stored").alias("event_count"))
    refs = resolved_refs.groupBy("document_id").agg(F.count_if("found").alias("resolved"), F.count("*").alias("total"))
    out = documents.select(F.col("id").alias("document_id")).join(counts, "document_id", "left").join(refs, "document_id", "left")
    return out.select("document_id", F.lit("processed").alias("status"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("event_count", "resolved", "total")])


def no_responses(chunks: DataFrame) -> DataFrame:
    """An empty table of responses to these chunks."""
    return chunks.limit(0).select("document_id", "chunk_index", F.lit("").alias("response_text"))


def run_tables(documents: DataFrame, chunks: DataFrame, parsed_rows: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """The tables of a run by name; chunks, parsed_rows and events are stored ones."""
    refs = resolved(reference_rows(events), chunks)
    return {"chunks": chunks, "events": events, "locations": location_rows(events), "participants": participant_rows(events), "edges": edges(events), "references": refs, "summary": run_summary(documents, parsed_rows, refs)}
