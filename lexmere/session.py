"""Session helpers: shared storage, size checks, shipping this package to executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: A side with at most so many rows and bytes may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Rows and bytes of an Arrow batch: documents are some thousand bytes each, a few far longer, and both sides hold a batch or two.
ARROW_ROWS, ARROW_BYTES = 2_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='lexmere-')}"
        sc.setCheckpointDir(where)
    return where


def stored(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors. With `by`, in a folder for each value of those columns, so that filters on them skip the rest."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    # rebalanced, so that a large value is split over tasks and small ones share one
    (df.hint("rebalance", *by).write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def dropped(*tables: DataFrame) -> None:
    """Remove stored() tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    for df in tables[:1]:
        freed(df.sparkSession)


def freed(spark: SparkSession) -> None:
    """Let go of frames that nothing holds any more: Spark removes their shuffle files when the driver's memory is collected, which a driver with memory to spare does not do for long."""
    gc.collect()
    spark._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    """True if a file or folder is there, on whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if a count of rows and bytes proves it small, else df as it is (Spark then shuffles)."""
    fixed, size = 0, F.lit(0)
    for f in df.schema:
        if isinstance(f.dataType, (StringType, BinaryType)):
            size += F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            size += F.length(F.to_json(F.struct(f"`{f.name}`")))
        else:
            fixed += 8
    found = df.limit(rows + 1).select((size + fixed).cast("long").alias("b")).agg(F.count("*"), F.sum("b")).first()
    return F.broadcast(df) if found[0] <= rows and (found[1] or 0) <= most_bytes else df


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that do not have it installed, and send them rows in batches that suit whole documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_lexmere_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexmere-")) / "lexmere.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(target))
    sc._lexmere_shipped = True
