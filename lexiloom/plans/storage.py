"""Tables, written intermediate results and size-checked joins."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

BROADCAST_BYTES = 32_000_000
"""Largest measured size of a side that is broadcast; a larger one is joined by a shuffle."""

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

_own: list[str] = []
_left: list[tuple[SparkSession, str]] = []
_scopes = threading.local()
_shipped: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once for each Spark context, wherever they run."""
    context = spark.sparkContext
    if context not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = os.path.join(tempfile.mkdtemp(prefix="lexiloom-"), "lexiloom.zip")
        atexit.register(shutil.rmtree, os.path.dirname(archive), ignore_errors=True)
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(archive)
        _shipped[context] = archive
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """`ship`, and Arrow batches of BATCH_BYTES for a session that has the default of 64 MB, as a worker and its executor hold several
    at once. The registered queries and the pipeline's stages begin with it; operators leave a session's settings alone."""
    if spark.conf.get(BATCH, None) == "67108864b":
        spark.conf.set(BATCH, BATCH_BYTES)
    return ship(spark)


TEXT_TABLES = frozenset(("documents", "pages", "conversations"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables of a data folder. A table of texts that comes in fewer pieces than there are cores is spread over them;
    tables of a size that matters come in more, so they are never shuffled here."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if table in TEXT_TABLES and cores > 1 and df.rdd.getNumPartitions() < cores:
        return df.repartition(2 * cores)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where it may be unset, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexiloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear() -> None:
    """Delete the written results of this process, which no DataFrame may read any more."""
    while _left:
        spark, path = _left.pop()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and with it the means to delete
            _left.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialize` writes within are deleted at the end, but for those with keep."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            delete(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, lost executors cost nothing.

    Within `scratch` the table goes when that ends; with keep it outlives the innermost scratch. What is in none, as results are, goes when
    the process ends, or with `clear`.
    """
    spark = ship(df.sparkSession)
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    stack = _scopes.__dict__.setdefault("stack", [])
    if len(stack) > keep:
        stack[-1 - keep].append(path)
    else:
        if not _left:
            atexit.register(clear)
        _left.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """The bytes of a written table's values, in one scan; what a broadcast of it would hold, less the overhead of its rows."""
    total = F.lit(16)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(kind, (ArrayType, MapType, StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + 8
    return df.agg(F.sum(total.cast("long")).alias("n")).first()["n"] or 0


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its measured size is within BROADCAST_BYTES."""
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES else df


def lookup_join(big: DataFrame, side: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a side that is measured first: broadcast up to BROADCAST_BYTES, by shuffle beyond.

    `side` should be a written table, as it is read for that. Keys equal by <=>, so null keys match.
    """
    other = {c: f"__r_{c}" for c in on}
    while set(other.values()) & {*big.columns, *side.columns}:
        other = {c: f"_{x}" for c, x in other.items()}
    side = small(side.select(*[F.col(c).alias(other.get(c, c)) for c in side.columns]))
    equal: Column = reduce(and_, [F.col(c).eqNullSafe(F.col(other[c])) for c in on])
    joined = big.join(side, equal, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*other.values())


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, str], name: str = "running") -> DataFrame:
    """rows with a column for each of values (new name: numeric column): its sum over the rows of equal keys that come before in order.

    A sorted table is written in ranges of (keys, order); a range adds what the ranges before it hold of its first key. So a key
    that holds most rows is spread over as many tasks as it has ranges. Rows that tie in all of keys and order come in any order.
    """
    at = "__range"
    sorted_ = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(at, F.spark_partition_id())
    written = materialize(sorted_, name)
    parts = materialize(written.groupBy(at, *keys).agg(*[F.sum(v).alias(k) for k, v in values.items()]), f"{name}-ranges")
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range a key is in
    base = parts.select(at, *keys, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__{k}") for k in values])
    own = Window.partitionBy(at, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = written.select("*", *[F.coalesce(F.sum(v).over(own), F.lit(0)).alias(k) for k, v in values.items()])
    joined = lookup_join(local, materialize(base, f"{name}-bases"), [at, *keys])
    return joined.select(*rows.columns, *[(F.col(k) + F.col(f"__{k}")).alias(k) for k in values])
