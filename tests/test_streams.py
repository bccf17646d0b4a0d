"""Tables that micro-batches write to."""

import os

from pyspark.sql import functions as F

from lexmere.operators import store
from lexmere.streaming import jobs
from lexmere.streaming.tables import Appended, Bucketed


def files(path):
    return {f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_writes_its_new_rows_alone(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string")
    table = Appended(spark, f"file://{tmp_path}/t", rows(1).schema, "id")
    table.add(rows(*range(100)), "a", 0)
    before = {f: os.path.getsize(f) for f in files(tmp_path)}
    table.add(rows(5, 100, 100, None, None), "a", 1)
    assert all(os.path.getsize(f) == n for f, n in before.items())
    assert spark.read.parquet(f"{tmp_path}/t/a-1").count() == 3
    table.add(rows(5, 100, 100, None, None), "a", 1)  # again
    table.add(rows(5, 100, 101), "b", 0)  # after a lost checkpoint
    assert sorted(x.id for x in table.read().collect() if x.id is not None) == list(range(102)) and table.read().count() == 104
    table.add(rows(), "b", 1)
    assert table.read().count() == 104


def test_ingest_goes_on_and_begins_anew(spark, tmp_path):
    docs = lambda a, b: spark.range(a, b).selectExpr("id", "concat('d', id) name").coalesce(1)
    start = lambda c: jobs.drained(spark, jobs.ingest(spark, f"{tmp_path}/in", docs(0, 1).schema, f"file://{tmp_path}/out", f"file://{tmp_path}/{c}"))
    for c, a, b in (("c1", 0, 5), ("c1", 3, 8), ("c2", 0, 9)):
        docs(a, b).write.mode("append").parquet(f"{tmp_path}/in")
        start(c)
    assert sorted(x.id for x in jobs.ingested(spark, f"file://{tmp_path}/out", docs(0, 1).schema).collect()) == list(range(9))
    assert len(os.listdir(f"{tmp_path}/out")) == 3


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    rows = lambda of: spark.createDataFrame(of, "document_id long, chunk_index long, title string")
    table = Bucketed(spark, f"file://{tmp_path}/t", rows([(1, 1, "")]).schema, "document_id", 8)
    replace = lambda old, batch: store.replaced(old, batch, batch, ["document_id", "chunk_index"])
    assert table.read().count() == 0
    table.apply(rows([(d, c, f"{d}.{c}") for d in range(200) for c in range(2)]), "a", 0, replace)
    before = files(tmp_path)
    assert len(table.apply(rows([(7, 1, "new"), (7, 1, "newer")]), "a", 1, replace)) == 1
    new = files(tmp_path) - before
    assert before <= files(tmp_path) and len({os.path.basename(os.path.dirname(f)) for f in new}) == 1
    want = sorted([(d, c, f"{d}.{c}") for d in range(200) for c in range(2) if (d, c) != (7, 1)] + [(7, 1, "new"), (7, 1, "newer")])
    assert sorted(map(tuple, table.read().collect())) == want
    assert table.apply(rows([(7, 1, "again")]), "a", 1, replace) == set() and table.apply(rows([]), "a", 2, replace) == set()
    assert sorted(map(tuple, table.read().collect())) == want
    assert table.read(1).count() == 400  # an older version is still there
    # a bucket that is emptied, and a job that died before its manifest
    table.apply(rows([(7, 0, "x")]), "b", 0, lambda old, batch: old.where("document_id <> 7"))
    rows([(1, 1, "lost")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/t/data/dead-0")
    table.expire(2)
    assert sorted(map(tuple, table.read().collect())) == [x for x in want if x[0] != 7]
    assert not os.path.exists(f"{tmp_path}/t/data/dead-0") and len(table.versions()) == 2 and table.read(table.versions()[0]).count() == 401


def test_null_keys_have_a_bucket(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1, "a"), (2, 1, "b")], "document_id long, chunk_index long, title string")
    table = Bucketed(spark, f"file://{tmp_path}/t", rows.schema, "document_id")
    table.apply(rows, "a", 0, lambda old, batch: old.unionByName(batch))
    assert sorted(x.title for x in table.read().collect()) == ["a", "b"]
