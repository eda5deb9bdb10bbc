"""Shared helpers: staged tables, ordered shards and raw byte files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small.

    Batches are bounded in rows and, where this Spark can, in bytes, so that a
    run of very long texts never makes one huge batch."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where the session runs in one process (tests) may the setting be
    absent; then it is set to a local folder. On a cluster its absence is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='formsift-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/formsift/{name}-{uuid.uuid4().hex}"


#: Lets a finished write give back the disk of its own shuffles; if they are asked for again, Spark reruns those stages.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: work is done once, lineage
    is cut, and a lost executor costs no recomputation of what came before. The
    shuffles of that work are given back at once."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    try:
        spark.conf.set(_CLEAN, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Staged tables of one piece of work. All are deleted when it ends, so what
    its result still reads must be staged elsewhere."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.paths = spark, shared_path(spark, name), {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{len(self.paths)}-{name}"
        out = staged(df, name, path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete some of the tables early."""
        for path in [p for p, kept in self.paths.items() if any(kept is t for t in tables)]:
            self.paths[path] = None
            delete(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A tokenizer file on this machine, driver or executor: a path, or the name of
    a public one, looked up where the code runs."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def let(value: Column, body) -> Column:
    """Evaluate value once and use it many times inside body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def write_frames(df: DataFrame, path: str, per_file: int = 0) -> None:
    """Write the binary column `frame` of df, back to back, one file a partition
    or, if per_file is given, each so many frames.

    Every frame must end in a zero byte: the text writer puts it there as its
    line separator. Spark's commit protocol keeps one copy of each file even if
    tasks are retried, and any file system that Spark can reach will do."""
    body = F.expr("CAST(substring(frame, 1, length(frame) - 1) AS STRING)").alias("value")
    df.select(body).write.option("maxRecordsPerFile", per_file).option("lineSep", "\u0000").option("compression", "none").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


#: Most shards of an order, as their bounds are one constant; beyond it they grow, and tasks stream longer.
MAX_SHARDS = 50_000


def order_bounds(df: DataFrame, key: str, text: str, shard_bytes: int) -> list[int]:
    """First keys of the shards 1, 2, ... of df by ascending key.

    Their number follows the bytes of text up to MAX_SHARDS; the list is as long
    as there are shards, whatever the number of rows."""
    total = df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    shards = min(MAX_SHARDS, max(1, -(-total // shard_bytes)))
    if shards == 1:
        return []
    cuts = [i / shards for i in range(1, shards)]
    found = df.agg(F.percentile_approx(key, cuts, 20 * shards).alias("q")).first()["q"] or []
    return sorted(set(found))


def bounds_array(bounds: list[int]) -> Column:
    """The bounds as one constant."""
    return F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")


def shard_of(key: str, bounds: list[int]) -> Column:
    """Shard number of a key: how many bounds are at most it (null: 0), by binary search."""
    if not bounds:
        return F.lit(0)
    cuts, value = bounds_array(bounds), F.col(key)

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.try_element_at(cuts, mid + 1) <= value)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(F.least(mid, s["hi"])).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.coalesce(F.when(value.isNotNull(), F.aggregate(steps, start, halve, lambda s: s["lo"])), F.lit(0)).cast("int")


def in_order(df: DataFrame, key: str, bounds: list[int], *ties: str) -> DataFrame:
    """df with a column `shard`, one partition a shard, each sorted by key, then ties."""
    out = df.withColumn("shard", shard_of(key, bounds))
    return out.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.asc_nulls_first(key), *[F.asc_nulls_first(t) for t in ties])
