"""Shared helpers: the cluster's shared folder, written intermediate tables, fold expressions."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and SQL form of the white space that separates words: space and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that setting is absent (tests in local mode) a folder of our own is made once per session; on a cluster its absence is an error,
    as every machine would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="cachelens-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_made: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A new path for intermediate tables below the shared folder."""
    _made.append(f"{shared_dir(spark)}/cachelens/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all workspaces made within it.  Results that are still to be read must be written elsewhere before."""
    n = len(_made)
    try:
        yield
    finally:
        dropped(spark, *_made[n:])
        del _made[n:]


def whole(docs: DataFrame) -> Column:
    """A caller's row as one struct, so that none of its columns can clash with an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back: cuts lineage and survives the loss of any executor."""
    spark, schema = df.sparkSession, df.schema
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner remove shuffle files of finished plans now rather than at some later GC.

    Memory that the driver's Python has freed is returned as well.  The cleaner works in the background; the short wait lets it finish before the next stage writes.
    """
    tidy()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def tidy() -> None:
    """What a Python worker has freed goes back to the system, so that workers waiting between stages are small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the decimal text of ``doc_id`` modulo ``k``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def hot_hash(*cols: Column) -> Column:
    """A non-negative 62-bit hash that does not depend on partitioning, for deterministic sampling."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes; a longer text stands alone."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def handfuls(column: pa.Array, most: int = 256) -> Iterator[list]:
    """The values of an Arrow column as Python lists of at most ``most``, so that a batch never stands twice in memory."""
    for a in range(0, len(column), most):
        yield column.slice(a, most).to_pylist()


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions on dictionaries of columns.

    ``make`` runs once per task and returns the function for each batch; that function takes
    ``{name: pa.Array}`` and returns the output columns as lists or arrays, or None for no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows and (cols := f({n: b.column(i) for i, n in enumerate(b.schema.names)})) is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == t.type else pa.array(x, t.type) for x, t in zip((cols[n] for n in out.names), out)], schema=out)

    return df.mapInArrow(run, out_schema(schema))


def out_schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
