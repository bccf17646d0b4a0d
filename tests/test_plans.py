"""Chunk plans, content extractors and event extractors."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lexmere import catalog
from lexmere.fixtures import Views
from lexmere.operators import chunks, reads
from lexmere.plans import corpus_run, waves
from lexmere.session import stored
from lexmere.sources import extractors
from tests.test_queries import SF


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_split_once(spark):
    """The optimizer copies the sentence pattern into no filter and no other column."""
    docs = Views(spark, SF).v_document.select("id", "text_content")
    for df in (chunks.chunks(docs, 1200), chunks.chunks(docs, 1200).where("chunk_index = 0 and text <> ''"), chunks.sentences(docs)):
        assert optimized(df).count("regexp_extract_all") == 1


def test_chunking_is_linear(spark):
    """Four times the text takes nowhere near sixteen times as long, with few chunks and with many."""
    text = "Una frase de prueba, Dr. Paz. " * 180_000
    docs = lambda n: spark.createDataFrame([(1, text[: n * 1_300_000])], "id long, text_content string")
    for target in (1200, 262_144):

        def took(n):
            began = time.time()
            found = chunks.chunks(docs(n), target).agg(F.count("*"), F.max(F.length("text"))).first()  # noqa: B023
            assert found[0] >= n * 1_300_000 / target * 0.9 and found[1] <= 1.5 * target  # noqa: B023
            return time.time() - began

        took(1)
        assert took(4) < 8 * max(took(1), 0.5)


def test_abbreviations(spark):
    text = "El art. 5 de la Ley. Vino la Dra. Ruiz. Era S.A. Dijo etc. y no. Cra. 5 es calle. Fin No. 7"
    split = lambda a: [s.strip() for s in spark.createDataFrame([(text,)], "t string").select(chunks.sentence_array(F.col("t"), a)).first()[0]]
    assert split(chunks.ABBREVIATIONS) == ["El art. 5 de la Ley.", "Vino la Dra. Ruiz.", "Era S.A. Dijo etc. y no.", "Cra.", "5 es calle.", "Fin No. 7"]
    assert split((*chunks.ABBREVIATIONS, "Cra"))[3] == "Cra. 5 es calle."
    assert len(split(())) == 11
    with pytest.raises(ValueError):
        chunks.sentence_array(F.col("t"), [f"a{i}" for i in range(501)])


def test_odd_texts_in_chunks(spark):
    rows = [(1, None), (2, ""), (3, " \n\t" * 30), (4, "x" * 100), (5, "." * 60), (6, "a. " * 50), (6, "a. " * 50), (None, "b. " * 50), (7, "…\x00 ¿?! " * 20)]
    docs = spark.createDataFrame(rows, "id long, text_content string").withColumn("t", F.lit(1)).withColumn("s", F.lit(1)).withColumn("groups", F.lit(1))
    got = chunks.chunks(docs, 40).collect()
    of = {k: t or "" for k, t in rows}
    for x in got:
        assert x.text == of[x.document_id][x.offset_start : x.offset_end]
    assert [(x.offset_start, x.text) for x in got if x.document_id == 3] == [(90, "")]
    assert sum(x.document_id == 6 for x in got) == 2 * sum(x.document_id is None for x in got) > 2
    assert chunks.chunks(docs.limit(0), 40).count() == 0


def test_zero_sizes(spark):
    """Sizes of 0 begin no group before anything has come, and stand behind a size over the target."""
    r = random.Random(3)
    from tests.test_operators import plain_groups

    cases = [(i, [r.choice([0, 0, 1, 5, 30, 400]) for _ in range(r.randint(1, 30))]) for i in range(300)]
    got = {x.id: x.b for x in spark.createDataFrame(cases, "id int, n array<int>").select("id", chunks.group_breaks("n", 100).alias("b")).collect()}
    assert got == {i: plain_groups(n, 100) for i, n in cases}
    odd = spark.createDataFrame([(None,), ([],), ([None, 3],)], "n array<int>").select(chunks.group_breaks("n", 2)).collect()
    assert [x[0] for x in odd] == [[0], [0], [0]]


# --- content extractors


def test_extractors_by_format(spark):
    rows = [
        (1, "a.txt", b"uno\x0cdos\x0c\x0cfin"), (2, "b.HTML", "<h1>Título</h1><!-- no --><style>p{}</style>a &lt; b".encode()), (3, "c.json", b'{"text": "hola"}'), (4, "d.json", b"{bad"), (5, "e.pdf", b"\xff\xfe"),
        (6, None, b"sin nombre"), (7, "f.txt", None), (8, "g.txt", b""), (8, "g.txt", b"again"), (9, "h.rev", b"abc"), (10, "i.rev", b"no"), (None, "j.txt", b"no id"),
    ]
    df = spark.createDataFrame(rows, "id long, filename string, content binary").withColumn("row", F.lit(1)).withColumn("t", F.lit(2)).withColumn("extractor", F.lit(3))

    def reverse(content, name):
        if content == b"no":
            raise KeyError(name)
        return content.decode()[::-1], [0, 1, len(content)]

    got = extractors.extracted(df, extractors.EXTRACTORS | {"rev": extractors.per_blob(reverse)}).collect()
    one = {x.id: x for x in got if x.id != 8}
    assert len(got) == len(rows)
    assert one[1].page_offsets == [0, 3, 7, 8, 12] and one[1].text_content == "uno\x0cdos\x0c\x0cfin"
    assert one[2].text_content == "Título a < b" and one[3].text_content == "hola"
    assert one[4].text_content is None and "JSON" in one[4].error_message and one[4].page_offsets is None
    assert (one[5].doc_format, one[5].extractor) == ("pdf", "plain_text") and one[5].error_message
    assert one[6].text_content == "sin nombre" and one[7].error_message and one[None].text_content == "no id"
    assert sorted(x.text_content for x in got if x.id == 8) == ["", "again"]
    assert one[9].text_content == "cba" and one[9].page_offsets == [0, 1, 3] and one[10].error_message.startswith("KeyError")
    lazy = extractors.extracted(df, {"plain_text": lambda rows: extractors.plain_text(rows.where("filename = 'a.txt'"))}).collect()
    assert len(lazy) == len(rows) and sum(x.error_message == "the extractor returned no row" for x in lazy) == len(rows) - 1
    assert extractors.extracted(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        extractors.extracted(df, {})


def test_a_branch_reads_its_own_rows(spark):
    df = spark.createDataFrame([(1, "a.txt", b"x"), (2, "b.json", b"{}")], "id long, filename string, content binary")
    plans = []

    def seen(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return extractors.plain_text(rows)

    extractors.extracted(df, {"plain_text": seen})
    assert "PartitionFilters: [isnotnull(extractor" in plans[0]


# --- event extractors

DOCS = "id long, text_content string, provider_id string, model string, llm_mode string"


def said(*events):
    return json.dumps({"events": [{"title": t, "time_start": d, "references": [{"reference_type": "time", "verbatim_text": t}]} for t, d in events]})


def test_a_later_wave_sees_earlier_events(spark):
    docs = spark.createDataFrame([(1, "Uno fue ayer. Dos fue hoy. Tres sera luego. ", "p", "m", "thinking"), (2, "Solo uno.", "p", "m", "thinking"), (3, None, None, None, None)], DOCS).withColumn("prompt", F.lit("x"))

    def ask(prompt):
        prior, _, text = prompt.rpartition("\n\n")
        if "Dos" in text:
            assert '"title":"Uno"' in prior
        if "Tres" in text:
            assert prior.index('"title":"Dos"') < prior.index('"title":"Uno"')  # latest first
            raise OSError("down")
        return said((text.split()[0], "2024-01-02" if "Uno" in text else "2024-01-03")) if text else "I cannot"

    out = waves.run(docs, waves.calling(ask, 2), 15)
    calls = {(x.document_id, x.chunk_index): x for x in out["calls"].collect()}
    assert set(calls) == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)}
    assert calls[1, 2].response_text is None and calls[1, 2].error == "OSError: down" and '"title":"Uno"' in calls[1, 1].prompt
    assert "Events so far" not in calls[1, 0].prompt
    assert {tuple(x) for x in out["summary"].collect()} == {(1, "processed", 2, 2, 2), (2, "processed", 1, 1, 1), (3, "processed", 0, 0, 0)}


def test_waves_give_what_stored_responses_give(spark):
    v = Views(spark, SF)
    docs, responses = v.v_document.where("id < 30"), catalog._responses(v)
    a, b = waves.run(docs, waves.answers(responses), 8000), corpus_run.run(docs, responses, 8000)
    for name in ("events", "references", "participants", "locations", "summary"):
        assert sorted(map(str, a[name].collect())) == sorted(map(str, b[name].select(*a[name].columns).collect())), name


def test_a_stopped_run_goes_on(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Uno va. Dos va. Tres va. ", "p", "m", "thinking")], DOCS)
    asked = []

    def stops(wave):
        n = len(asked)
        asked.append(n)
        if n == 1:
            raise RuntimeError("stopped")
        return wave.select("document_id", "chunk_index", F.lit(said(("va", "2024-01-01"))).alias("response_text"), F.lit(7).alias("total_tokens"))

    with pytest.raises(RuntimeError):
        waves.run(docs, stops, 8, where=f"file://{tmp_path}/run")
    out = waves.run(docs, stops, 8, where=f"file://{tmp_path}/run")
    assert asked == [0, 1, 2, 3] and out["summary"].first().event_count == 3
    assert [x.total_tokens for x in out["calls"].collect()] == [7, 7, 7]


def test_extractors_that_answer_too_much_or_nothing(spark):
    docs = spark.createDataFrame([(1, "Uno.", "p", "m", "thinking")], DOCS)
    twice = lambda wave: wave.select("document_id", "chunk_index", F.explode(F.array(F.lit(said(("b", "2024-01-01"))), F.lit(said(("a", "2024-01-01"))))).alias("response_text")).union(wave.selectExpr("document_id + 1", "chunk_index", "'{}'"))
    out = waves.run(docs, twice)
    assert [x.title for x in out["events"].collect()] == ["a"] and out["calls"].count() == 1
    none = waves.run(docs, lambda wave: wave.selectExpr("document_id", "chunk_index", "'' response_text").limit(0))
    assert none["events"].count() == 0 and none["summary"].first().event_count == 0
    empty = waves.run(docs.limit(0), twice)
    assert empty["calls"].count() == 0 and empty["summary"].count() == 0


def test_token_batches_of_one_large_key(spark):
    """A million rows of one key, in order and in linear time; and small keys as one row after another gives them."""
    rows = spark.range(1_000_000).selectExpr("if(id % 1000 = 0, id, -1) k", "id o", "repeat('x', cast(id % 90 as int)) t")
    got = chunks.token_batches(rows, "k", "o", "t", 1000).where("k = -1").groupBy("batch").agg(F.count("*").alias("n"), F.min("o").alias("first"), F.max("o").alias("last")).orderBy("batch").collect()
    assert sum(x.n for x in got) == 999_000 and [x.batch for x in got] == list(range(len(got)))
    assert all(a.last < b.first for a, b in zip(got, got[1:]))
    r = random.Random(5)
    small = [(r.choice(["a", "b", None]), i, "x" * r.choice([0, 5, 50, 900])) for i in range(300)]
    want, state = {}, {}
    for k, o, t in small:
        n = max(1, (len(t) + 14) // 4)
        filled, number = state.get(k, (0, 0))
        filled, number = (n, number + 1) if filled and filled + n > 100 else (filled + n, number)
        state[k] = filled, number
        want[o] = number
    df = spark.createDataFrame(small, "k string, o long, t string").repartition(5)
    assert {x.o: x.batch for x in chunks.token_batches(df, "k", "o", "t", 100).collect()} == want
    assert chunks.token_batches(df.limit(0), "k", "o", "t").count() == 0


def test_learned_abbreviations(spark):
    plain = ["La casa grande come pan. El pan es casa.", "El pan come la casa. La casa es pan grande."]
    rows = [(i, plain[i % 2] + " Vive en la Avda. Colón con la Sgta. Ruiz de la S.R.L. Sur.") for i in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "id long, text_content string")
    learned = {x.word for x in chunks.learned_abbreviations(docs).collect()}
    assert {"Avda", "Sgta", "S.R.L"} <= learned and not {"casa", "pan", "grande", "La", "la"} & learned
    own = chunks.abbreviations(chunks.learned_abbreviations(docs))
    assert own[: len(chunks.ABBREVIATIONS)] == chunks.ABBREVIATIONS
    texts = [x.text for x in chunks.sentences(docs.where("id = 0"), own).collect()]
    assert "Vive en la Avda. Colón con la Sgta. Ruiz de la S.R.L. Sur." in texts
    assert chunks.learned_abbreviations(docs.where("id >= 900")).count() == 0


def test_names_are_asked_once(spark, tmp_path):
    from lexmere.operators import store

    places = [(1, 1, "Lima", None, None), (2, 1, "Lima", None, None), (3, 2, "Quito", 1.0, 2.0), (4, 2, "Nowhere", None, None), (5, 3, "Down", None, None), (6, 3, None, None, None), (7, 3, " ", None, None)]
    loc = spark.createDataFrame(places, "id long, event_id long, name string, lat double, lon double")
    none = spark.createDataFrame([], "name string, lat double, lon double")
    where = str(tmp_path)

    def geocode(name):
        with open(f"{where}/asked", "a") as f:
            f.write(name + "\n")
        if name == "Down":
            raise OSError
        return (-12, -77) if name == "Lima" else None

    cache = store.looked_up(loc, none, geocode)
    assert {tuple(x) for x in cache.collect()} == {("Lima", -12.0, -77.0), ("Nowhere", None, None)}
    got = {x.id: x.lat for x in store.geocoded(loc, cache).collect()}
    assert got == {1: -12.0, 2: -12.0, 3: 1.0, 4: None, 5: None, 6: None, 7: None}
    store.looked_up(loc, cache, geocode).count()
    assert sorted(open(f"{where}/asked").read().split()) == ["Down", "Down", "Lima", "Nowhere"]
    assert store.looked_up(loc, none, lambda n: None, 1).collect() == [("Down", None, None)]


def test_a_wave_reads_its_own_responses_alone(spark):
    """Stored responses are made once and read by chunk index: a wave's plan neither makes them again nor reads other folders."""
    responses = spark.range(40).selectExpr("id % 8 document_id", "id div 8 chunk_index", "concat('r', id) response_text")
    extract, asked = waves.answers(responses), stored(responses.selectExpr("document_id", "cast(chunk_index as int) chunk_index", "'t' text"), by=["chunk_index"])
    found = extract(asked.where("chunk_index = 3"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*chunk_index#\d+ = 3", plan)) == 2 and "Range" not in plan
    assert sorted(x.response_text for x in found.collect()) == [f"r{i}" for i in range(24, 32)]


def test_document_status_shuffles_no_text(spark):
    docs = spark.createDataFrame([(i, "ab cd " * i, "processed", "p1") for i in range(6)], "id long, text_content string, status string, provider_id string")
    providers = spark.createDataFrame([("p1", "One")], "id string, name string")
    rows = spark.createDataFrame([(1, 1), (1, 2), (4, 3)], "document_id long, event_id long")
    got = reads.document_status(docs, providers, rows, rows, rows)
    assert [(x.id, x.word_count, x.event_count, x.chunk_count, x.reference_count) for x in got.orderBy("id").collect()] == [(i, 2 * i, *[{1: 2, 4: 1}.get(i, 0)] * 3) for i in range(6)]
    joins = optimized(got).split("\n")
    counted = next(k for k, line in enumerate(joins) if "regexp_extract_all" in line)
    assert any("Join" in line for line in joins[:counted])
