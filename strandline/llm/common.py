"""Shared helpers of the training-data operators: inputs, intermediate tables, Arrow kernels."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space and the letters that the contracts name.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named on a local master (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _TEMPORARY.setdefault("root", "file://" + tempfile.mkdtemp(prefix="strandline-"))
    return root.rstrip("/")


_TEMPORARY: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1000, n_bytes: int = 4 << 20) -> None:
    """Rows go to Python in batches of so many rows and bytes at most, of the session and for good: results are lazy.

    Batches are held outside the heap, several at a time; only their size depends on this, never a result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", n_bytes)


def released(kernel: Callable) -> Callable:
    """The kernel of a mapInArrow, after which the worker gives its free memory back: it lives on for other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it keeps free memory for later


def replayable(docs: DataFrame, name: str) -> DataFrame:
    """docs, whose rows come in the same order whenever they are read: as they are if they are scanned from files, else stored."""
    nodes = re.findall(r"^[\s:+-]*(?:\*\(\d+\) )?(\w+)", docs._jdf.queryExecution().sparkPlan().toString(), re.M)
    plain = nodes and all(n in ("Project", "Filter", "FileScan", "ColumnarToRow", "LocalTableScan") for n in nodes)
    return docs if plain else store(docs, name)


def arrow_map(df: DataFrame, kernel: Callable[[dict], Iterable[dict]], schema: str, batch_rows: int = 2000) -> DataFrame:
    """Run kernel on every Arrow batch as a dict of Python lists and write the dicts of lists that it yields.

    The batch is cut so that at most batch_rows rows are Python objects at a time.
    """
    spark = df.sparkSession
    small_batches(spark)
    out = pa.schema([(f.name, _arrow(f.dataType)) for f in spark.createDataFrame([], schema).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                for cols in kernel(batch.slice(at, batch_rows).to_pydict()):
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(released(run), schema)


def arrow_keep(df: DataFrame, of: tuple[str, ...], kernel: Callable[[dict], list[bool]], batch_rows: int = 256) -> DataFrame:
    """The rows of df that kernel keeps, by what it says of each one; it gets the columns `of` as Python lists.

    All other columns pass as they are, whatever their names, so that each row is decided by itself and none is joined.
    """
    small_batches(df.sparkSession, batch_rows)
    at = [df.columns.index(c) for c in of]
    placed = df.toDF(*(f"column{i}" for i in range(len(df.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, batch_rows):
                part = batch.slice(begin, batch_rows)
                yield part.filter(pa.array(kernel({c: part.column(i).to_pylist() for c, i in zip(of, at, strict=True)}), pa.bool_()))

    return placed.mapInArrow(released(run), placed.schema).toDF(*df.columns)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "left", salts: int = 64) -> DataFrame:
    """left joined with right, which has each key once, where one key may hold a third of left.

    Keys of more than a thousandth of left's rows, a thousand at most, are dealt over `salts` by the column spread of
    left; right repeats them for each salt.  Only these keys are broadcast.  left is read twice, so it should be stored.
    """
    from pyspark.sql import functions as F

    n = left.count()
    hot = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(1000, n // 1000)).select(F.col(key).alias("_hot"))
    hot = F.broadcast(hot.limit(1000))
    dealt = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("long")).drop("_hot")
    every = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(every.cast("array<long>"))).drop("_hot")
    return dealt.join(repeated, [key, "_salt"], how).drop("_salt")
