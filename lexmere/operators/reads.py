"""Relational read products: lists, details, totals and the map layer. Every function maps DataFrames to a DataFrame."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmere.functions import scalars as S
from lexmere.session import stored

SORTS = ("time_start", "time_end", "created_at", "title", "model")
#: Model label of events that name none.
NO_MODEL = "(sin modelo)"


def both(conditions: list[Column]) -> Column:
    """All of them; none: true."""
    return reduce(and_, conditions, F.lit(True))


def event_filter(search: str | None = None, document: int | None = None, model: str | None = None) -> Column:
    """B1, B2, B4, B5."""
    c = [] if search is None else [F.col("title").ilike(f"%{search}%")]
    c += [] if document is None else [F.col("document_id") == document]
    return both(c + ([] if model is None else [F.col("model") == model]))


def of_source(events: DataFrame, documents: DataFrame, source: str) -> DataFrame:
    """Events of the documents of a source group."""
    ids = documents.where(F.col("source_id") == source).select(F.col("id").alias("document_id"))
    return events.join(ids, "document_id", "left_semi")


def event_order(sort: str | None = None, order: str | None = None) -> list[Column]:
    """an allowed column, else time_start; descending unless the order is a word that does not begin with `desc`; nulls as the larger values; ties by id."""
    c = F.col(sort if sort in SORTS else "time_start")
    return [c.desc_nulls_first() if (order or "desc").lower().startswith("desc") else c.asc_nulls_last(), F.col("id")]


def page_of(df: DataFrame, order: list[Column], page: int = 1, per_page: int = 20) -> DataFrame:
    """one page; page from 1, per_page 1 to 100."""
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page is at least 1, per_page 1 to 100")
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def totals(df: DataFrame, per_page: int = 20, least_pages: int = 0) -> DataFrame:
    """Rows and pages; an empty list has least_pages pages."""
    return df.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(least_pages), F.ceil(F.col("total") / per_page)).cast("long").alias("pages"))


def child_counts(children: DataFrame, name: str) -> DataFrame:
    """Rows per event."""
    return children.groupBy("event_id").agg(F.count("*").alias(name))


def first_location(locations: DataFrame) -> DataFrame:
    """One location per event, the one with the least id."""
    return locations.groupBy("event_id").agg(F.min_by("name", "id").alias("location_name"))


def event_list(events: DataFrame, documents: DataFrame, providers: DataFrame, locations: DataFrame, participants: DataFrame, refs: DataFrame, where: Column | None = None, sort: str | None = None, order: str | None = None, page: int = 1, per_page: int = 20) -> DataFrame:
    """Filter, order and cut first; only the page's rows are joined to the rest."""
    rows = stored(page_of(events.where(F.lit(True) if where is None else where), event_order(sort, order), page, per_page))
    keys = F.broadcast(rows.select(F.col("id").alias("event_id")))  # at most 100 rows
    child = lambda df: df.join(keys, "event_id", "left_semi")
    out = rows.withColumn("event_id", F.col("id"))
    out = out.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")
    out = out.join(providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name")), "provider_id", "left")
    out = out.join(first_location(child(locations)), "event_id", "left")
    out = out.join(child_counts(child(participants), "participant_count"), "event_id", "left").join(child_counts(child(refs), "reference_count"), "event_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("id", "document_id", "filename", "provider_name", "model", "title", S.iso(F.col("time_start")).alias("time_start"), "location_name", zero("participant_count"), zero("reference_count"))


def event_detail(events: DataFrame, documents: DataFrame, providers: DataFrame, locations: DataFrame, participants: DataFrame, refs: DataFrame) -> DataFrame:
    """Each event with its children as ordered arrays; confidence 0 is shown as null."""
    array = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    loc = locations.groupBy("event_id").agg(array("id", "name", "lat", "lon").alias("locations"))
    par = participants.groupBy("event_id").agg(array("id", "name", "role", F.nullif("confidence", F.lit(0.0)).alias("confidence")).alias("participants"))
    ref = refs.groupBy("event_id").agg(array("chunk_index", "span_start", "id", "reference_type", "verbatim_text").alias("references"))
    out = events.withColumn("event_id", F.col("id")).join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")
    out = out.join(providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name")), "provider_id", "left")
    for c in (loc, par, ref):
        out = out.join(c, "event_id", "left")
    return out.select("id", "title", "filename", "provider_name", F.nullif("extraction_confidence", F.lit(0.0)).alias("confidence"), "locations", "participants", "references")


def usage_totals(usage: DataFrame, *keys: str) -> DataFrame:
    """Sums per key (none: of all rows); null sums are 0, cost stays null."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    grouped = usage.groupBy(*keys)
    return grouped.agg((F.count("*") > 0).alias("has_data"), F.count("*").alias("calls"), *map(total, ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens", "duration_ms")), F.round(F.sum("cost"), 6).alias("cost"))


def source_sizes(documents: DataFrame) -> DataFrame:
    """Documents per source group."""
    return documents.groupBy(F.coalesce("source_id", F.col("id").cast("string")).alias("source_id")).agg(F.count("*").alias("model_count"))


def document_counts(documents: DataFrame, events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Events and chunks per document."""
    e = events.groupBy("document_id").agg(F.count("*").alias("event_count"))
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    out = documents.select("id").join(e, F.col("id") == e.document_id, "left").drop("document_id").join(c, F.col("id") == c.document_id, "left")
    return out.select("id", F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def document_list(documents: DataFrame, providers: DataFrame, usage: DataFrame, events: DataFrame, chunks: DataFrame, where: Column | None = None, page: int = 1, per_page: int = 20) -> DataFrame:
    """The newest documents first; counts and totals only for the page's rows (C17)."""
    rows = stored(page_of(documents.where(F.lit(True) if where is None else where), [F.col("created_at").desc_nulls_first(), F.col("id")], page, per_page))
    keys = F.broadcast(rows.select(F.col("id").alias("document_id")))  # at most 100 rows
    mine = lambda df: df.join(keys, "document_id", "left_semi")
    tokens = mine(usage).groupBy("document_id").agg(F.sum("total_tokens").alias("total_tokens"))
    sources = F.broadcast(rows.select("source_id").distinct())
    out = rows.join(providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name")), "provider_id", "left")
    out = out.join(tokens, out.id == tokens.document_id, "left").drop("document_id")
    out = out.join(source_sizes(documents.join(sources, "source_id", "left_semi")), "source_id", "left")
    out = out.join(document_counts(rows, mine(events), mine(chunks)), "id")
    return out.select("id", "filename", "status", "provider_name", S.word_count(F.col("text_content")).alias("word_count"), F.coalesce("total_tokens", F.lit(0)).cast("long").alias("total_tokens"), "model_count", "event_count", "chunk_count")


def document_status(documents: DataFrame, providers: DataFrame, events: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """Status, provider and counts of every document. Words are counted where texts are read: no text is shuffled."""
    d = documents.select("id", "status", "provider_id", S.word_count(F.col("text_content")).alias("word_count"))
    r = refs.groupBy("document_id").agg(F.count("*").alias("reference_count"))
    out = d.join(document_counts(documents, events, chunks), "id").join(providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name")), "provider_id", "left")
    out = out.join(r, out.id == r.document_id, "left")
    return out.select("id", "status", "provider_name", "word_count", "event_count", "chunk_count", F.coalesce("reference_count", F.lit(0)).alias("reference_count"))


def valid_box(min_lon: float | None, min_lat: float | None, max_lon: float | None, max_lat: float | None) -> tuple[float, float, float, float] | None:
    """None of the four, or all of them in range and in order."""
    box = (min_lon, min_lat, max_lon, max_lat)
    if all(v is None for v in box):
        return None
    if any(v is None for v in box):
        raise ValueError("a bounding box needs all four sides")
    if not (-180 <= min_lon <= max_lon <= 180 and -90 <= min_lat <= max_lat <= 90):
        raise ValueError("longitudes are -180 to 180, latitudes -90 to 90, least first")
    return box


def map_layer(locations: DataFrame, events: DataFrame, documents: DataFrame, box: tuple[float, float, float, float] | None = None, limit: int = 500) -> DataFrame:
    """Located events in the box, latest first, nulls last; box and limit are applied before the joins need them."""
    if not 1 <= limit <= 2000:
        raise ValueError("limit is 1 to 2000")
    x = valid_box(*box) if box else None
    at = both([F.col("lat").isNotNull(), F.col("lon").isNotNull()] + ([F.col("lon").between(x[0], x[2]), F.col("lat").between(x[1], x[3])] if x else []))
    rows = locations.where(at).select("event_id", F.col("name").alias("location_name"), "lat", "lon").join(events.withColumnRenamed("id", "event_id"), "event_id")
    rows = rows.orderBy(F.col("time_start").desc_nulls_last(), "event_id").limit(limit)
    named = rows.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")
    return named.select("event_id", "title", "filename", "location_name", "lat", "lon", S.iso(F.col("time_start")).alias("time_start"))


def _upto(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `upto`: the sum of w over all rows up to their own in this order, by a prefix scan over parts of bounded size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    # one row per part
    before = cut.groupBy("part").agg(F.sum("w").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("w").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("within", within).join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.col("within"))


def boxes_hit(boxes: DataFrame, locations: DataFrame) -> DataFrame:
    """B10 as data: (box, n) located points in every valid box.

    Boxes never meet points in pairs. Equal points, and boxes of equal sides,
    stand once. Longitudes are numbered; a box is at most two blocks of 2**j
    numbers for each j, and in a block its points are those up to its greatest
    latitude less those under its least, both from one prefix scan over all
    blocks: n log n rows, however many points a box holds.
    """
    sides = ["min_lon", "max_lon", "min_lat", "max_lat"]
    ok = boxes.where("min_lon between -180 and max_lon and max_lon <= 180 and min_lat between -90 and max_lat and max_lat <= 90")
    ok = ok.select("box", *[F.col(c).cast("double").alias(c) for c in sides])
    once = stored(ok.select(*sides).distinct().withColumn("k", F.monotonically_increasing_id()))
    points = locations.where("lon between -180 and 180 and lat between -90 and 90").select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    points = stored(points.groupBy("lon", "lat").agg(F.count("*").alias("w")))
    # kinds: 0 a low end, 1 a point, 2 a high end
    ends = lambda of, at: of.selectExpr("k", f"min_{at} at", "0 kind", "0L w").unionByName(of.selectExpr("k", f"max_{at} at", "2 kind", "0L w"))
    numbered = stored(_upto(ends(once, "lon").unionByName(points.select("lon").distinct().selectExpr("-1L k", "lon at", "1 kind", "1L w")), "at", "kind", "k").select("k", "at", "kind", "upto"))
    number = numbered.where("kind = 1").selectExpr("at lon", "upto - 1 number")
    span = numbered.where("kind <> 1").groupBy("k").agg(F.min(F.expr("if(kind = 0, upto, null)")).alias("lo"), F.max(F.expr("if(kind = 2, upto, null)")).alias("hi"))
    top = max((number.agg(F.max("number")).first()[0] or 0).bit_length(), 1)
    low, high = "shiftright(lo + shiftleft(1L, j) - 1, j)", "shiftright(hi, j)"
    blocks = once.join(span, "k").select("k", "min_lat", "max_lat", F.expr(f"explode(sequence(0, {top})) j"), "lo", "hi").selectExpr("k", "min_lat", "max_lat", "j", f"{low} lo", f"{high} hi").where("lo < hi")
    blocks = blocks.select("k", "min_lat", "max_lat", "j", F.explode_outer(F.expr("filter(array(if(lo % 2 = 1, lo, null), if(hi % 2 = 1, hi - 1, null)), b -> b is not null)")).alias("block")).where("block is not null")
    sought = blocks.selectExpr("j", "block", "k", "min_lat at", "0 kind", "0L w").unionByName(blocks.selectExpr("j", "block", "k", "max_lat at", "2 kind", "0L w"))
    held = points.join(number, "lon").select(F.expr(f"explode(sequence(0, {top})) j"), "number", "lat", "w").selectExpr("j", "shiftright(number, j) block", "-1L k", "lat at", "1 kind", "w")
    held = held.groupBy("j", "block", "k", "at", "kind").agg(F.sum("w").alias("w"))
    sums = _upto(sought.unionByName(held), "j", "block", "at", "kind", "k").where("kind <> 1")
    n = sums.groupBy("k").agg(F.sum(F.expr("if(kind = 2, upto, -upto)")).alias("n"))
    counted = once.join(n, "k", "left").drop("k")
    return ok.join(counted, sides).groupBy("box").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def model_colors(events: DataFrame, colors: DataFrame) -> DataFrame:
    """Distinct pairs of a named model and its provider's colour."""
    named = events.where((F.col("model").isNotNull()) & (F.col("model") != ""))
    return named.join(colors, "provider_id", "left").select("model", "color_index").distinct()


def color_of_model(events: DataFrame, colors: DataFrame) -> DataFrame:
    """The greatest colour of each model, null if none has one."""
    return model_colors(events, colors).groupBy("model").agg(F.max("color_index").alias("color_index"))


def provider_list(providers: DataFrame, model: str, base_url: str) -> DataFrame:
    """The default first, with the configured model; keys masked."""
    mine = lambda c, cfg: F.when(F.col("is_default"), F.lit(cfg)).otherwise(F.col(c)).alias(c)
    shown = providers.select("id", "name", mine("model", model), mine("base_url", base_url), S.masked_key(F.col("api_key")).alias("api_key"), "is_default")
    return shown.withColumn("position", F.row_number().over(W.orderBy(F.col("is_default").desc(), "name")).cast("long"))


def sampling(documents: DataFrame, providers: DataFrame) -> DataFrame:
    """A provider's own values, else 0.7, 0.9 and 40; none outside instruct mode."""
    own = providers.select(F.col("id").alias("provider_id"), "instruct_temperature", "instruct_top_p", "instruct_top_k")
    on = F.lower(F.trim("llm_mode")) == "instruct"
    of = lambda c, d: F.when(on, F.coalesce(c, F.lit(d))).alias(c)
    return documents.join(own, "provider_id", "left").select("id", of("instruct_temperature", 0.7), of("instruct_top_p", 0.9), of("instruct_top_k", 40))


def log_page(log: DataFrame, page: int = 1) -> DataFrame:
    """Newest first, 50 a page, severities clamped."""
    rows = log.withColumn("severity", F.when(F.col("severity").isin("info", "warning", "error"), F.col("severity")).otherwise("info"))
    return page_of(rows, [F.col("arrival").desc(), F.col("document_id"), F.col("step_name")], page, 50)


def call_page(calls: DataFrame, page: int = 1, per_page: int = 50) -> DataFrame:
    """Oldest first."""
    return page_of(calls, [F.col("arrival").asc(), F.col("document_id")], page, per_page)


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """Chunk texts with document and chunk offsets."""
    return chunks.select("document_id", "chunk_index", "text", "offset_start", "offset_end", F.lit(0).cast("long").alias("relative_start"), F.length("text").cast("long").alias("relative_end"))


def in_context(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each reference's span as its chunk has it."""
    c = chunks.select("document_id", "chunk_index", "text", "offset_start")
    met = refs.join(c, ["document_id", "chunk_index"])
    return met.select("id", F.substring("text", (F.col("span_start") - F.col("offset_start") + 1).cast("int"), (F.col("span_end") - F.col("span_start")).cast("int")).alias("shown"))


def models_present(events: DataFrame) -> DataFrame:
    """Distinct models, dated or not."""
    return events.select(F.coalesce(F.when(F.col("model") != "", F.col("model")), F.lit(NO_MODEL)).alias("model")).distinct()
