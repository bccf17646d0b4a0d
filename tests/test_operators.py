"""Literal cases of single operators."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmere import catalog
from lexmere.functions import scalars as S
from lexmere.operators import chunks, entities, reads, refs, store, timeline
from lexmere.operators.components import connected_components
from lexmere.plans import corpus_run
from lexmere.sources import ingest


def plain_groups(sizes, target):
    """Greedy fill, tail merge and second split, one size after another."""

    def fill(t):
        breaks, size = [], 0
        for i, n in enumerate(sizes):
            if size > 0 and size + n > t:
                breaks.append(i)
                size = n
            else:
                size += n
        return breaks[:-1] if breaks and size < 0.5 * t else breaks

    total = sum(sizes)
    if total <= target:
        return [0]
    first = fill(target)
    return [0, *(first if first or len(sizes) == 1 else fill(-(-total * 51 // 100)))]


@pytest.mark.parametrize("sizes,target,groups", [([1, 1, 1, 1], 2, [0, 2]), ([5000], 1000, [0])])
def test_groups_literal(spark, sizes, target, groups):
    assert spark.createDataFrame([(sizes,)], "n array<int>").select(chunks.group_breaks("n", target)).first()[0] == groups


def test_groups_random(spark):
    r = random.Random(5)
    cases = [(i, [r.randint(1, 90) for _ in range(r.randint(1, 40))]) for i in range(400)] + [(1000, [100] * 13), (1001, [100] * 3367)]
    df = spark.createDataFrame(cases, "id int, n array<int>")
    for target in (100, 1000):
        got = {x.id: x.b for x in df.select("id", chunks.group_breaks("n", target).alias("b")).collect()}
        assert got == {i: plain_groups(n, target) for i, n in cases}


def test_sentences_and_chunks(spark):
    text = "El Dr. Paz llegó. La S.L. no pagó! ¿Quién? Fin\nde todo."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text_content string")
    s = [x.text for x in chunks.sentences(docs).where("document_id = 1").orderBy("sentence_no").collect()]
    assert s == ["El Dr. Paz llegó.", "La S.L. no pagó!", "¿Quién?", "Fin\nde todo."]
    got = {(x.document_id, x.chunk_index): x for x in chunks.chunks(docs, 20).collect()}
    for x in got.values():
        assert x.text == (text if x.document_id == 1 else "")[x.offset_start : x.offset_end]
    assert (got[2, 0].offset_start, got[2, 0].offset_end, got[2, 0].page_start) == (0, 0, 1)
    paged = docs.where("id = 1").withColumn("page_offsets", F.array(F.lit(0), F.lit(18), F.lit(len(text))))
    assert [(x.page_start, x.page_end) for x in chunks.chunks(paged, 20).orderBy("chunk_index").collect()][-1][1] == 2


def test_white_space_between_sentences_counts_for_no_chunk(spark):
    text = "\n\n  " + "Una frase.\n\n\n\n" * 6
    docs = spark.createDataFrame([(1, text)], "id long, text_content string")
    got = [(x.text, x.offset_start, x.offset_end) for x in chunks.chunks(docs, 30).orderBy("chunk_index").collect()]
    three = "Una frase.\n\n\n\nUna frase.\n\n\n\nUna frase."
    assert got == [(three, 4, 4 + len(three)), (three, 46, 46 + len(three))]


def test_chunks_where_both_targets_agree(spark):
    """ceil(0.51 * total) may be the target itself; sentences stand once all the same."""
    text = " ".join(["Una frase de 21 letr."] * 5 + ["Fin de esto, y ya."])
    docs = spark.createDataFrame([(1, text)], "id long, text_content string")
    for t in (62, 63, 64):  # sentences have 123 characters, 51 % of which are 63
        got = chunks.chunks(docs, t).orderBy("chunk_index").collect()
        assert all(x.text == text[x.offset_start : x.offset_end] for x in got)
        assert " ".join(x.text for x in got) == text


def test_dates(spark):
    cases = {"2024-01-02T03:04:05Z": "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05+02:00": "2024-01-02T01:04:05+00:00", "2024-01-02": "2024-01-02T03:00:00+00:00", " 2024-01-02 03:04:05 ": "2024-01-02T06:04:05+00:00", "": None, "mayo": None, "2024-01-02T03:04:05.123": None}
    df = spark.createDataFrame(list(cases.items()), "t string, w string")
    for r in df.select("t", "w", S.iso(S.parsed_date(F.col("t"))).alias("g")).collect():
        assert r.g == r.w, r


def test_quotes(spark):
    c = spark.createDataFrame([(1, 0, "…ñandú Corre por la PAMPA hoy", 1000)], "document_id long, chunk_index long, text string, offset_start long")
    rows = [(1, 1, 0, "Corre", 0, 0), (2, 1, 0, "pampa", 0, 0), (3, 1, 0, "gone", 99, 110), (4, 1, 7, "Corre", 5, 6), (5, 1, 0, None, 1, 2), (6, 1, 0, "", 1, 2)]
    r = spark.createDataFrame(rows, "id long, document_id long, chunk_index long, verbatim_text string, span_start long, span_end long")
    got = {x.id: (x.span_start, x.span_end, x.found) for x in refs.resolved(r, c).collect()}
    assert got == {1: (1007, 1012, True), 2: (1020, 1025, True), 3: (99, 110, False), 4: (5, 6, False), 5: (1, 2, False), 6: (1, 2, False)}


def test_boxes():
    assert reads.valid_box(None, None, None, None) is None
    for bad in ((1, None, 2, 3), (5, 0, 4, 1), (-181, 0, 0, 1), (0, 0, 1, 91)):
        with pytest.raises(ValueError):
            reads.valid_box(*bad)


def test_points_in_boxes(spark):
    """Counts of any boxes, and no join in which boxes meet points: that one grows with the product of both."""
    r = random.Random(11)
    near = lambda most: r.choice([float(r.randint(-most, most)), r.uniform(-most, most), r.uniform(0, 2)])
    points = [(i, near(180), near(90)) for i in range(700)] + [(i, 1.5, 1.5) for i in range(300)] + [(9, None, 1.0), (9, 1.0, None), (9, -0.0, 0.0), (9, float("nan"), 0.0)]
    boxes = [(i, *sorted((near(180), near(180))), *sorted((near(90), near(90)))) for i in range(300)]
    boxes += [(900, -180.0, 180.0, -90.0, 90.0), (901, 1.5, 1.5, 1.5, 1.5), (902, 2.0, 1.0, 0.0, 1.0), (903, 0.0, 181.0, 0.0, 1.0), (904, None, 1.0, 0.0, 1.0), (905, 0.0, 0.0, 0.0, 0.0), (5, -1.0, 1.0, -1.0, 1.0), (906, 179.5, 179.6, 89.9, 90.0)]
    hits = reads.boxes_hit(spark.createDataFrame(boxes, "box int, min_lon double, max_lon double, min_lat double, max_lat double"), spark.createDataFrame(points, "id int, lon double, lat double"))
    want = {}
    for b, x0, x1, y0, y1 in boxes:
        if None not in (x0, x1) and -180 <= x0 <= x1 <= 180 and -90 <= y0 <= y1 <= 90:
            want[b] = want.get(b, 0) + sum(x is not None and y is not None and x0 <= x <= x1 and y0 <= y <= y1 for _, x, y in points)
    got = hits.collect()
    assert {x.box: x.n for x in got} == want and len(got) == len(want)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "min_lon" in plan and not re.search(r"Join.*lat#\d+ [<>]=", plan)
    none = spark.createDataFrame([], "id int, lon double, lat double")
    assert {x.n for x in reads.boxes_hit(spark.createDataFrame(boxes[:5], "box int, min_lon double, max_lon double, min_lat double, max_lat double"), none).collect()} == {0}


def test_colours(spark):
    p = spark.createDataFrame([(f"p{i:02}", i) for i in range(23)], "id string, created_at int")
    c = spark.createDataFrame([(f"p{i:02}", i) for i in (0, 2, 3)], "provider_id string, color_index int")
    got = {x.provider_id: x.color_index for x in store.assigned_colors(p, c).collect()}
    assert got["p01"] == 1 and got["p04"] == 4 and sorted(got.values())[:5] == [0, 1, 1, 2, 4] and len(got) == 20


def test_pages(spark):
    pages = spark.createDataFrame([(1, 0, "ab"), (1, 1, ""), (1, 2, "cde")], "document_id long, page_no int, text string")
    x = ingest.assembled(pages).first()
    assert x.text_content == "ab\f\fcde" and x.page_offsets == [0, 2, 3, 7]
    bad = spark.createDataFrame([(1, bytearray(b"\xff\xfe"))], "id long, raw binary").select("id", F.base64("raw").alias("original_blob"))
    assert ingest.decoded(bad).first().error_message


def test_rebuilt_pages_of_odd_documents(spark, tmp_path):
    """An empty text begins and ends at 0; the query gives its SQL's rows on empty, null and short texts."""
    rows = [(1, 0, 1, 0, 0), (2, 0, 1, 0, 500), (2, 1, 2, 500, 700), (3, 0, 2, 40, 90)]
    c = spark.createDataFrame(rows, "document_id long, chunk_index int, page_start int, offset_start int, offset_end int")
    got = {r.document_id: r.page_offsets for r in refs.rebuilt_pages(c).collect()}
    assert got == {1: [0, 0], 2: [0, 500, 700], 3: [0, 40, 90]}
    texts = [(1, ""), (2, None), (3, "x"), (4, "y" * 500), (5, "z" * 1501), (None, "no id")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.queries()["e5_rebuilt_pages"](spark, str(tmp_path)).collect()
    want = con.execute(f"select document_id, offsets from ({catalog.oracle_sql()['e5_rebuilt_pages']})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_placement(spark):
    r = random.Random(2)
    rows = [(i, f"m{r.randint(0, 2)}", "t", "d", f"2024-0{r.randint(1, 3)}-{r.randint(1, 28):02} 0{r.randint(0, 9)}:00:00") for i in range(300)]
    e = spark.createDataFrame(rows, "id long, model string, title string, description string, ts string").selectExpr("*", "cast(ts as timestamp_ntz) time_start", "'p' provider_id")
    height = {x.month: x.height for x in timeline.month_grid(e).collect()}
    columns = {}
    for i, m, _, _, ts in rows:
        columns.setdefault((ts[:7], m), []).append((ts, i))
    want = {}
    for (month, _), of in columns.items():
        of.sort()
        h, ys = height[month], []
        days = {"2024-01": 31, "2024-02": 29, "2024-03": 31}[month]
        for ts, _ in of:  # down until there is room, then back up from the end
            base = 4 + (int(ts[8:10]) - 1) / (days - 1) * (h - 8 - 92)
            ys.append(max(base, ys[-1] + 96) if ys else base)
        low = h - 92
        for k in range(len(ys) - 1, -1, -1):
            ys[k] = min(ys[k], low)
            low = ys[k] - 96
        want |= {i: round(y, 4) for (_, i), y in zip(of, ys)}
    got = {x.id: x.y for x in timeline.placed(e).collect()}
    assert all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == find(n) for n in list(root))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_entities(spark):
    e = spark.createDataFrame([(1, "José Paz"), (2, "Corte"), (3, "Corte Suprema")], "id long, name string")
    m = spark.createDataFrame([(1, "jose  PAZ"), (2, "la corte supre"), (3, "nadie"), (4, None), (5, "or")], "id long, verbatim_text string")
    assert {(x.id, x.entity_id) for x in entities.exact(m, e).collect()} == {(1, 1)}
    assert {(x.id, x.entity_id, x["rank"]) for x in entities.fuzzy(m, e).collect()} == {(1, 1, 1), (2, 2, 1), (5, 2, 1), (5, 3, 2)}
    assert {x.id: x.stage for x in entities.cascade(m, e).collect()} == {1: "exact", 2: "fuzzy", 3: "create", 4: "create", 5: "fuzzy"}


def test_run_is_repeatable(spark):
    docs = spark.createDataFrame([(1, "Uno fue. Dos fue.", "p", "m", "instruct")], "id long, text_content string, provider_id string, model string, llm_mode string")
    text = '{"events":[{"title":"a","time_start":"2024-01-01","participants":[{"name":" x "},{"name":null}],"references":[{"reference_type":"time","verbatim_text":"dos FUE"},{"reference_type":"odd"}]}]}'
    resp = spark.createDataFrame([(1, 0, text), (1, 9, text), (2, 0, "nope")], "document_id long, chunk_index int, response_text string")
    out = corpus_run.run(docs, resp)
    assert out["summary"].collect()[0].asDict() == {"document_id": 1, "status": "processed", "event_count": 1, "resolved": 1, "total": 1}
    assert [(x.name, x.role) for x in out["participants"].collect()] == [("x", "subject")]
    assert out["events"].first().model == "m [I]" and out["references"].first().span_start == 9
    assert out["events"].collect() == corpus_run.run(docs, resp)["events"].collect()
    once = store.replaced(out["edges"], out["edges"], out["edges"], ["document_id", "chunk_index"])
    assert sorted(once.collect()) == sorted(out["edges"].collect())


def test_no_key_gathers_the_pairs(spark):
    """One-letter names meet nearly every text; no key's block holds over a hundredth of the pairs, and all pairs are found."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 6))) for _ in range(200)]
    texts = sorted({" ".join(r.choice(words) for _ in range(4)) for _ in range(3000)})
    needles = [*"abcdefghij", "ab", "a ", *words[:40], "nowhere", texts[0]]
    n = spark.createDataFrame([("x", w) for w in needles] + [("y", "abc")], "side string, needle string")
    t = spark.createDataFrame([("x", w) for w in texts] + [("y", "b")], "side string, text string")
    blocks = [x["count"] for x in entities.dealt(n, t, 200).groupBy("side", "key", "block").count().collect()]
    assert sum(blocks) > 20_000 and max(blocks) <= sum(blocks) / 100
    got = sorted((x.needle, x.text) for x in entities.contained(n, t, 200).collect())
    assert got == sorted((w, u) for w in needles for u in texts if w in u)


def test_containment_of_odd_names(spark):
    e = spark.createDataFrame([(1, "a"), (2, "Á"), (3, None), (4, "  "), (5, "ab"), (6, "a b c"), (6, "a b c")], "id long, name string")
    m = spark.createDataFrame([(1, "A"), (2, ""), (3, None), (4, "xaby"), (5, "B")], "id long, verbatim_text string")
    got = sorted((x.id, x.entity_id) for x in entities.fuzzy(m, e, 99).collect())
    assert got == [(1, 1), (1, 2), (1, 5), (1, 6), (4, 1), (4, 2), (4, 5), (5, 5), (5, 6)]
    assert entities.fuzzy(m.limit(0), e).count() == entities.fuzzy(m, e.limit(0)).count() == 0


@pytest.mark.parametrize("rows,roots", [
    ([(1, 2), (2, 3), (3, 1)], {1: 1, 2: 1, 3: 1}),
    ([(4, 5), (5, 4), (6, 5), (7, 6), (8, 8), (9, None), (10, 99)], {4: 4, 5: 4, 6: 4, 7: 4, 8: 8, 9: 9, 10: 99}),
    ([(i, i + 1) for i in range(40)] + [(40, None), (50, 0), (51, 50)] + [(100 + i, 100 + (i + 1) % 13) for i in range(13)] + [(200 + i, 201 + i) for i in range(30)] + [(230, 105)], {**dict.fromkeys([*range(41), 50, 51], 40), **dict.fromkeys([*range(100, 113), *range(200, 231)], 100)}),
    ([(None, 1), (1, None), (1, None), (2, 3), (2, 1), (3, None)], {1: 1, 2: 1, 3: 3}),
    ([], {}),
])
def test_merges(spark, rows, roots):
    got = entities.merged_roots(spark.createDataFrame(rows, "id long, superseded_by long")).collect()
    assert {x.id: x.root for x in got} == roots and len(got) == len(roots)


def test_quotes_of_a_chunk_are_searched_together(spark):
    text = ("Sobre la ÑANDÚ y el río. " * 400) + "aaaaab fin"
    r = random.Random(6)
    quotes = ["", "ñandú", "a", "aa", "aaab", "zz", "fin", "Fin", "FIN", "río. Sobre", "RÍO. s"] + [text[i : i + r.randint(1, 40)] for i in (r.randrange(len(text) - 40) for _ in range(300))]
    assert refs.positions(text, quotes) == [text.find(q) for q in quotes]
    rows = [(i, 1, 0, q, 5, 6) for i, q in enumerate([*quotes, None])] + [(1000, None, 0, "a", 5, 6), (1001, 1, None, "a", 5, 6), (1002, 1, 0, "fin", None, None), (1002, 1, 0, "fin", None, None)]
    refs_in = spark.createDataFrame(rows, "id long, document_id long, chunk_index long, verbatim_text string, span_start int, span_end int").withColumn("text", F.lit("x")).withColumn("part", F.lit(1))
    c = spark.createDataFrame([(1, 0, text, 10), (1, 0, "other", 99), (1, 1, None, 0), (2, 0, "a", 0)], "document_id long, chunk_index int, text string, offset_start int").withColumn("parts", F.lit(1))
    want = lambda q: next((p + 10 for p in (text.find(q), text.lower().find(q.lower())) if p >= 0), None) if q else None
    got = refs.resolved(refs_in, c).collect()
    assert len(got) == len(rows)
    for x in got:
        at = want(x.verbatim_text) if x.document_id and x.chunk_index == 0 else None
        assert (x.found, x.span_start) == (at is not None, at if at is not None else 5 if x.id < 1002 else None), x
        assert at is None or x.span_end == at + len(x.verbatim_text)
    parts = refs.located(refs_in.where("verbatim_text <> ''").selectExpr("document_id", "chunk_index", "verbatim_text quote").distinct(), c, 40).where("document_id = 1 and chunk_index = 0")
    assert {x.quote: x["at"] for x in parts.collect()} == {q: want(q) for q in quotes if q}
    assert refs.resolved(refs_in.limit(0), c).count() == 0 and refs.resolved(refs_in, c.limit(0)).where("found").count() == 0


def test_a_chunk_is_sent_once(spark):
    """Texts are dealt by (document, chunk) once, for the join with their quotes' counts, and lie right for the search."""
    from lexmere.session import stored

    r = stored(spark.range(10).selectExpr("id", "id document_id", "id chunk_index", "concat(id, 'q') verbatim_text", "1 span_start", "2 span_end"))
    c = stored(spark.range(10).selectExpr("id document_id", "id chunk_index", "concat('mark', id) text", "0 offset_start"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = refs.resolved(r, c)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    search = next(i for i, x in enumerate(lines) if "FlatMapCoGroupsInArrow" in x)
    scan = next(i for i, x in enumerate(lines) if i > search and "Scan parquet" in x and "text#" in x)
    # what stands above the scan of the texts, up to the search
    way, at = [], depth(lines[scan])
    for x in reversed(lines[search:scan]):
        if depth(x) < at:
            way, at = [*way, x], depth(x)
    assert sum("Exchange" in x for x in way) == 1, plan
