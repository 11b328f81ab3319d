"""Helpers every operator of this subpackage shares: the shared folder, staged tables, Arrow text access."""

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Taken from spark.checkpoint.dir; a temporary one is set only where
    that is unset and all run on one machine (local sessions, tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="registrum-shared-")
        spark.sparkContext.setCheckpointDir(f"file://{known}")
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors, and gives the planner
    the true size for its choice of joins."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


_scopes: list[list[str]] = []


def removed(spark: SparkSession, *paths: str) -> None:
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """Tables staged inside are removed at the end, but for those that are given to what this yields: they go to the scope around it, if
    there is one. What leaves the scope must not read the others."""
    opened: list[str] = []
    _scopes.append(opened)

    def keep(df: DataFrame) -> DataFrame:
        opened.remove(df.staged_at)
        if len(_scopes) > 1:
            _scopes[-2].append(df.staged_at)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        removed(spark, *opened)


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df for the small side of a join: broadcast if it has no more than `rows` rows (of narrow tables: 200,000 rows are some
    20 MB), else left to be shuffled. df should be staged: its rows are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of texts that go to a Python worker at once: with the ten thousand that suit numbers, two tasks of an executor hold as much
#: again as its workers need.
BATCH = 2_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session gives Python workers at most BATCH rows at once."""
    if int(spark.conf.get(_BATCH_ROWS)) > BATCH:
        spark.conf.set(_BATCH_ROWS, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row in them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


_kept: dict = {}


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the system: workers outlive tasks, and one executor has several."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def kept(key, build):
    """What build() gives, kept for a worker's next tasks until a task asks for something else."""
    if key not in _kept:
        _kept.clear()
        tidy()
        _kept[key] = build()
    return _kept[key]


def lean(run):
    """A function over Arrow batches that starts without what other operators keep in the worker, and leaves no freed memory behind."""

    def wrapped(batches):
        if _kept:
            _kept.clear()
            tidy()
        yield from run(batches)
        tidy()

    return wrapped
