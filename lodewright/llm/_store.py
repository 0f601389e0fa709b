"""Written intermediate tables and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one where it is unset (local runs)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        known = getattr(spark.sparkContext, "_lodewright_dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        known = "file://" + tempfile.mkdtemp(prefix="lodewright-")
        spark.sparkContext._lodewright_dir = known
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows_per_file: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lodewright_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these tables, once everything made of them has been written itself."""
    for t in tables:
        if path := getattr(t, "_lodewright_path", None):
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Rows of an Arrow batch where the session has Spark's default: texts are long, and batches are held on both sides.
BATCH_ROWS = 1000


def lean(run):
    """Give memory back to the system when a task ends: workers live on, and one operator's peak must not add to the next one's."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return held


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, over Spark's own file server."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_lodewright_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lodewright-"), "lodewright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("lodewright", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._lodewright_shipped = True
