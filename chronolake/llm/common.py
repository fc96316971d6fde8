"""What the corpus operators share: the scratch folder and stored tables, row keys, text as bytes, folds,
centres of clusters."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where it names none, a local session gets a folder of this machine; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        found = tempfile.mkdtemp(prefix="chronolake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Has Spark delete an execution's shuffle files as it ends; else they stay until the driver happens to collect what
#: refers to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """What runs meanwhile has the session's settings ``wanted``; then they are as before."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Tables that one run of an operator stores in the shared scratch folder.

    A stored table ends lineage: a lost executor costs a reread and never a recomputation of what led to
    it. Inner tables are dropped as soon as what was made of them is stored; a table that the operator's
    result reads stays, as its reader isn't known to have ended."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.inner: list[str] = []

    def _written(self, df: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        with settings(self.spark, {CLEANUP: "true"}):
            df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as an inner table."""
        path, table = self._written(df, name)
        self.inner.append(path)
        return table

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table that stays; all inner tables go."""
        _, table = self._written(df, name)
        self.clear()
        return table

    def clear(self) -> None:
        """Drops the inner tables, by the file system that holds them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.inner:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.inner = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table that stays."""
    return Scratch(df.sparkSession).finish(df, name)


def content_key(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of ``columns``: a key of 128 bits that is the same on every
    recomputation, unlike a row number. Rows that agree in ``columns`` share it."""
    return [
        F.xxhash64(*columns).alias("k1"),
        F.xxhash64(F.lit("second"), *reversed(columns)).alias("k2"),
    ]


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, mod ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def partitions_of(df: DataFrame) -> int:
    """Shuffle partitions that the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is stored by now: it does when the driver has collected what
    refers to them."""
    gc.collect()
    spark._jvm.System.gc()


_kept: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Returns what this process has freed to the machine, as after a model was fitted."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called by a task as it starts: a reused Python worker gives back what other operators kept in it.

    ``clear`` forgets what ``owner`` itself will keep from task to task."""
    others = [o for o in _kept if o != owner]
    for o in others:
        _kept.pop(o)()
    if others or owner not in _kept:
        give_back()
    _kept[owner] = clear or (lambda: None)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]


def k_means(data: np.ndarray, k: int, rounds: int, seed: int, spherical: bool) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = data[rng.choice(len(data), k, replace=len(data) < k)].copy()
    for _ in range(rounds):
        near = (data @ centres.T).argmax(axis=1) if spherical else squared(data, centres).argmin(axis=1)
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, data)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        centres[~full] = data[rng.choice(len(data), int((~full).sum()))]
        if spherical:
            centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-12)
    return centres
