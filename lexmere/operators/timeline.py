"""The multi-model timeline: months down, one column per model, events placed by day without overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmere.functions import scalars as S
from lexmere.operators.reads import NO_MODEL
from lexmere.session import small, stored

#: Height of an event with its gap, the gap, padding of a month, and width of a column.
SLOT, GAP, PAD, COLUMN = 96, 4, 4, 165


def _model() -> Column:
    return F.coalesce(F.when(F.col("model") != "", F.col("model")), F.lit(NO_MODEL)).alias("model")


def _month(at: Column) -> Column:
    return F.date_format(F.trunc(at, "month"), "yyyy-MM")


def _local(zone: str) -> Column:
    """time_start, which is UTC without a zone, as a clock in that zone shows it."""
    at = F.col("time_start").cast("timestamp_ntz")
    return at if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), at)


def _grid(counts: DataFrame, fill_months: bool) -> DataFrame:
    """(month, model, n) -> month_grid; counts may have several rows for a month and model."""
    n = counts.groupBy("month", "model").agg(F.sum("n").alias("n")).groupBy("month").agg(F.max("n").alias("most"))
    if fill_months:
        first = lambda c: F.to_date(F.concat(c, F.lit("-01")))
        ends = n.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null")
        every = ends.select(F.explode(F.sequence(first(F.col("a")), first(F.col("b")), F.expr("interval 1 month"))).alias("d"))
        n = every.select(_month(F.col("d")).alias("month")).join(n, "month", "left").select("month", F.coalesce("most", F.lit(0)).cast("long").alias("most"))
    height = F.greatest(F.lit(1), F.col("most")) * SLOT + GAP
    before = F.coalesce(F.sum("height").over(W.orderBy("month").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row per month: the window's single task reads as many rows as the calendar has months
    return n.withColumn("height", height).withColumn("top", before)


def month_grid(events: DataFrame, zone: str = "UTC", fill_months: bool = False) -> DataFrame:
    """(month, most events of a model, height, top). Months without events are left out, or one row high with fill_months."""
    dated = events.where("time_start is not null").select(_month(_local(zone)).alias("month"), _model())
    return _grid(dated.groupBy("month", "model").agg(F.count("*").alias("n")), fill_months)


def columns(events: DataFrame, colors: DataFrame) -> DataFrame:
    """(model, color_index, x): columns by colour, then name; one row per model."""
    # colours are met by models and providers, which are few, not by events
    pairs = events.groupBy(_model(), "provider_id").agg(F.count("*").alias("n"))
    c = pairs.join(colors, "provider_id", "left").groupBy("model").agg(F.max("color_index").alias("color_index"))
    rank = F.row_number().over(W.orderBy(F.coalesce("color_index", F.lit(99)), "model")) - 1
    return c.withColumn("x", (rank * COLUMN).cast("long"))


def _ranked(events: DataFrame, zone: str, carried: Sequence[Column] = ()) -> DataFrame:
    """A stored table of events in parts of bounded size, sorted by month, model, time and id over all parts; undated events come first."""
    at = _local(zone)
    rows = events.select("id", _model(), "provider_id" if "provider_id" in events.columns else F.lit(None).cast("string").alias("provider_id"), at.alias("at"), _month(at).alias("month"), F.dayofmonth(at).alias("day"), *carried)
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id is a border too: a day, or a moment, with a third of all events is cut like any other
    return stored(rows.repartitionByRange(parts, "month", "model", "at", "id").withColumn("part", F.spark_partition_id()))


def _placed(ranked: DataFrame, fill_months: bool) -> tuple[DataFrame, DataFrame]:
    """(events with position and y, month grid), by a prefix scan of three levels: days of a month and model, parts of a day, events of a part.

    A day's events have one base, so the running maximum of base - i * SLOT
    changes at a day's first event alone: it and the positions before a day
    come from at most 31 rows for each month and model.
    """
    column, body = ["month", "model"], SLOT - GAP
    counts = stored(ranked.where("month is not null").groupBy(*column, "day", "part").agg(F.count("*").alias("n"), F.min("at").alias("at")))
    grid = stored(_grid(counts, fill_months))
    days = counts.groupBy(*column, "day").agg(F.sum("n").alias("n"), F.min("at").alias("at")).join(small(grid.select("month", "height")), "month")
    by_day = W.partitionBy(*column).orderBy("day")
    first = F.coalesce(F.sum("n").over(by_day.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = PAD + S.day_fraction(F.col("at")) * (F.col("height") - 2 * PAD - body)
    days = days.withColumn("first", first).withColumn("all", F.sum("n").over(W.partitionBy(*column))).withColumn("down", F.max(base - F.col("first") * SLOT).over(by_day.rowsBetween(W.unboundedPreceding, 0)))
    days = days.select(*column, "day", "first", F.least(F.col("height") - body - (F.col("all") - 1) * SLOT, "down").alias("shift"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*column, "day").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = counts.select(*column, "day", "part", before.alias("before")).join(days, [*column, "day"]).select(*column, "day", "part", (F.col("first") + F.col("before")).alias("before"), "shift")
    within = F.row_number().over(W.partitionBy(*column, "day", "part").orderBy("at", "id")) - 1
    rows = ranked.where("month is not null").withColumn("within", within).join(small(stored(known)), [*column, "day", "part"])
    position = F.col("before") + F.col("within")
    return rows.withColumn("position", position.cast("long")).withColumn("y", F.round(position * SLOT + F.col("shift"), 4)), grid


def placed(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """(id, month, model, position, y) of dated events in closed form.

    With b the y that an event's day alone would give it, an event at position
    i stands at i * SLOT more than the greatest of b - j * SLOT over j <= i,
    but no lower than leaves room for those after it. Events of one time stand
    in order of their ids.
    """
    return _placed(_ranked(events, zone), False)[0].select("id", "month", "model", "position", "y")


def timeline(events: DataFrame, colors: DataFrame, zone: str = "UTC", fill_months: bool = False) -> DataFrame:
    """M1: everything a drawing needs, one row per dated event; texts travel with their event, so events are not joined to themselves."""
    ranked = _ranked(events, zone, [S.event_text(F.col("title"), F.col("description")).alias("label"), S.weekday_label(_local(zone)).alias("weekday")])
    rows, grid = _placed(ranked, fill_months)
    at = rows.join(small(grid), "month").join(small(stored(columns(ranked, colors))), "model")
    return at.select("id", "model", "x", "month", "top", (F.col("top") + F.col("y")).alias("y"), "height", "color_index", "label", F.col("weekday").alias("day"))


def by_model(events: DataFrame, documents: DataFrame) -> DataFrame:
    """M4: events per source group and model."""
    d = documents.select(F.col("id").alias("document_id"), "source_id")
    return events.join(d, "document_id").groupBy("source_id", "model").agg(F.count("*").alias("events"), F.count("time_start").alias("dated"))
