"""Mentions resolved to canonical entities: exact form first, then containment, then creation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmere.functions import scalars as S
from lexmere.session import small, stored


#: Pairs that one key's block holds at most, about, and blocks of a key.
PAIRS, MOST_BLOCKS = 1 << 16, 100_000


def exact(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """L1, C14: (id, entity_id) of mentions whose normal form some entity has; the least entity id wins."""
    e = entities.select(S.normal_form(F.col("name")).alias("key"), F.col("id").alias("entity_id")).where("key <> ''").groupBy("key").agg(F.min("entity_id").alias("entity_id"))
    return mentions.select("id", S.normal_form(F.col("verbatim_text")).alias("key")).join(e, "key").select("id", "entity_id")


def _runs(text: str, n: int) -> Column:
    """Distinct runs of n characters; none in shorter texts."""
    return F.expr(f"array_distinct(transform(sequence(1, greatest(length({text}) - {n - 1}, 1)), i -> substring({text}, i, {n})))")


def contained(needles: DataFrame, texts: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(side, needle, text): distinct non-empty needles (side, needle) with the distinct texts (side, text) of the same side that hold them. See `dealt`."""
    return dealt(needles, texts, pairs).where(F.contains("text", "needle")).select("side", "needle", "text")


def dealt(needles: DataFrame, texts: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(side, key, block, needle, text): the pairs that containment is tried on. Sides are few and apart.

    A needle of three characters or more is its rarest run of three, among the
    texts' runs; a run that no text has rules it out. Needles of one and two
    characters stand apart under themselves, and texts list such runs only
    where a needle is one. A key whose needles and texts make over `pairs`
    pairs is dealt, by its texts, to as many blocks as that takes, so a
    one-letter name that nearly every text holds gathers nowhere.
    """
    keys = ["side", "key"]
    needles = needles.select("side", "needle", F.length("needle").alias("_n"))
    threes = texts.where(F.length("text") >= 3).select("side", "text", F.explode(_runs("text", 3)).alias("key"))
    own = needles.where("_n >= 3").select("side", "needle", F.explode(_runs("needle", 3)).alias("key")).join(threes.groupBy(*keys).agg(F.count("*").alias("texts")), keys, "left")
    own = own.groupBy("side", "needle").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "key")).alias("k")).where("k.texts > 0").select("side", "needle", "k.key", "k.texts")
    # a short needle may be in every text
    most = max([r["count"] for r in texts.groupBy("side").count().collect()], default=0)
    keyed = stored(own.unionByName(needles.where("_n < 3").select("side", "needle", F.col("needle").alias("key"), F.lit(most).alias("texts"))))
    blocks = F.least(F.ceil(F.count("*") * F.max("texts") / pairs), F.max("texts"), F.lit(MOST_BLOCKS)).cast("int")
    known = small(keyed.groupBy(*keys).agg(blocks.alias("blocks")))
    few = texts.where("text <> ''").select("side", "text", F.explode(F.concat(_runs("text", 1), F.filter(_runs("text", 2), lambda r: F.length(r) == 2))).alias("key"))
    spread = threes.unionByName(few).join(known, keys).select(*keys, F.pmod(F.xxhash64("text"), "blocks").cast("int").alias("block"), "text")
    sent = keyed.join(known, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "needle")
    return spread.join(sent, [*keys, "block"])


def fuzzy(mentions: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """(id, entity_id, rank): entities whose normal form the mention's holds or is held by, shortest name first.

    Distinct normal forms of both sides are matched once, so repeated names
    and mentions meet as one text. Null and empty forms hold nothing and are
    held by nothing; equal forms hold each other.
    """
    m = mentions.select("id", S.normal_form(F.col("verbatim_text")).alias("m")).where("m <> ''")
    e = entities.select(F.col("id").alias("entity_id"), "name", S.normal_form(F.col("name")).alias("e")).where("e <> ''")
    form = lambda df, c, side: df.select(F.lit(side).alias("side"), F.col(c).alias("form"))
    forms = stored(form(m, "m", "m").unionByName(form(e, "e", "e")).distinct())
    # a needle is looked for in the forms of the other side
    other = F.when(F.col("side") == "m", "e").otherwise("m")
    held = contained(forms.select(other.alias("side"), F.col("form").alias("needle")), forms.select("side", F.col("form").alias("text")))
    of_mention = F.col("side") == "m"
    found = held.select(F.when(of_mention, F.col("text")).otherwise(F.col("needle")).alias("m"), F.when(of_mention, F.col("needle")).otherwise(F.col("text")).alias("e")).distinct()
    found = found.join(e, "e").select("m", "entity_id", "name").distinct()
    rank = F.row_number().over(W.partitionBy("m").orderBy(F.length("name"), "entity_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= most)
    return m.join(best, "m").select("id", "entity_id", F.col("rank").cast("long").alias("rank"))


def cascade(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, stage, entity_id, confidence, needs_create): each mention once, by the first stage that finds it."""
    a = stored(exact(mentions, entities).select("id", F.lit("exact").alias("stage"), "entity_id", F.lit(0.95).alias("confidence")))
    rest = mentions.join(a.select("id"), "id", "left_anti")
    b = stored(fuzzy(stored(rest), entities).where("rank = 1").select("id", F.lit("fuzzy").alias("stage"), "entity_id", F.lit(0.9).alias("confidence")))
    found = a.unionByName(b)
    new = mentions.join(found.select("id"), "id", "left_anti").select("id", F.lit("create").alias("stage"), F.lit(None).cast("long").alias("entity_id"), F.lit(0.6).alias("confidence"))
    return found.select("id", "stage", F.col("entity_id").cast("long").alias("entity_id"), "confidence").unionByName(new).withColumn("needs_create", F.col("stage") == "create")


def event_entities(events: DataFrame) -> DataFrame:
    """A canonical entity for each event."""
    props = F.to_json(F.struct(F.left("title", F.lit(80)).alias("title"), "description", "document_id"))
    return events.select("id", S.event_entity_name(F.col("title")).alias("name"), F.lit("event").alias("entity_type"), props.alias("properties"))


def links(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(event_id, entity_id) where the event's title and the entity's name hold one another."""
    titles = events.select(F.col("id"), F.col("title").alias("verbatim_text"))
    return fuzzy(titles, entities, most=1 << 30).select(F.col("id").alias("event_id"), "entity_id")


def merged_roots(entities: DataFrame) -> DataFrame:
    """(id, root): follow superseded_by to its end; entities on a cycle, and all that lead to it, end at the cycle's least id.

    Pointers are doubled each round, together with the least id on the way.
    An entity leaves the rounds once its end is known, so chains of up to n
    merges take log2(n) of them over ever fewer rows. On a chain all shorter
    distances occur, so when a round settles nothing, all that is left leads to
    cycles; when ways are as long as there are such entities, each points into
    its cycle, and the least id of one way around is known there.

    A superseded_by that no entity has is an end, and so is an entity's own id.
    Rows that repeat an id count once, by their least superseded_by; null ids
    are left out.
    """
    start = entities.where("id is not null").groupBy("id").agg(F.min("superseded_by").alias("to"))
    start = stored(start.select("id", F.when(F.col("to") != F.col("id"), F.col("to")).alias("to")))
    settled = [start.where("to is null").select("id", F.col("id").alias("root"))]
    going, way, chains = start.where("to is not null").select("id", "to", F.col("id").alias("least")), 1, True
    left = going.count()
    while left and (chains or way < left):
        step = going.alias("a").join(going.alias("b"), F.col("a.to") == F.col("b.id"), "left")
        step = stored(step.select("a.id", F.col("a.to").alias("at"), F.col("b.to").alias("to"), F.least("a.least", "b.least").alias("least")))
        if chains:
            known = reduce(DataFrame.unionByName, settled).select(F.col("id").alias("at"), "root")
            done = step.where("to is null").select("id", "at").join(known, "at", "left").select("id", F.coalesce("root", "at").alias("root"))
            settled.append(stored(done))
            chains = not settled[-1].isEmpty()
        going, way = step.where("to is not null").select("id", "to", "least"), 2 * way
        left = going.count()
    cycles = going.select(F.col("id").alias("to"), F.col("least").alias("root"))
    return reduce(DataFrame.unionByName, [*settled, going.select("id", "to").join(cycles, "to").select("id", "root")])


def reference_list(refs: DataFrame, events: DataFrame, documents: DataFrame, resolved: DataFrame, entities: DataFrame) -> DataFrame:
    """References with their event, document and entity."""
    out = refs.select("id", "event_id", "document_id", "reference_type", "verbatim_text")
    out = out.join(events.select(F.col("id").alias("event_id"), F.col("title").alias("event_title")), "event_id", "left")
    out = out.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")
    named = resolved.select("id", "entity_id").join(small(entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"))), "entity_id", "left")
    return out.join(named, "id", "left").select("id", "event_title", "filename", "reference_type", "verbatim_text", "entity_id", "entity_name")


def with_reference_counts(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entities with the number of mentions resolved to them."""
    n = resolved.groupBy("entity_id").agg(F.count("*").alias("reference_count"))
    return entities.join(n, entities.id == n.entity_id, "left").select("id", "name", F.coalesce("reference_count", F.lit(0)).alias("reference_count"))
