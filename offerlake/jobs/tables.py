"""Tables that several writers of one job change together, made current by one manifest."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKETS = 64
#: ``kind`` is the schema, as a folder may have no rows. An appended table's rows have no bucket; ``WHOLE`` stands for all that was appended before.
_MANIFEST = "batch bigint, name string, bucket int, path string, kind string"
WHOLE = -1


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines of a cluster share; one of our own only where it is
    unset and all runs on this machine, as in tests."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-offerlake-")


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder, for what is read more than once or must not change when read again."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucket_of(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_if_there(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or None where its folder does not exist yet."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    return read_if_there(lambda: spark.read.schema(_MANIFEST).parquet(f"{root}/commits"))


def is_committed(spark: SparkSession, root: str, batch_id: int) -> bool:
    found = _commits(spark, root)
    return found is not None and not found.filter(F.col("batch") == batch_id).isEmpty()


def commit_batch(appended: dict[str, DataFrame], replaced: dict[str, tuple[DataFrame, str, list[int]]], root: str, batch_id: int) -> None:
    """Write what a batch adds and the buckets that it replaces, then make all of it current at once.

    ``appended`` tables get more rows; of ``replaced`` ones (rows, key, buckets) the given buckets of the key give way to the
    rows. Every attempt writes to a folder of its own, which no reader knows before the manifest of the
    batch names it. A batch that was committed is not written again.
    """
    spark = next(iter([*appended.values(), *[df for df, *_ in replaced.values()]])).sparkSession
    if is_committed(spark, root, batch_id):
        return
    attempt = f"{root}/batch-{batch_id}-{uuid.uuid4().hex}"
    manifest = []
    for name, df in appended.items():
        df.write.parquet(f"{attempt}/{name}")
        manifest.append((batch_id, name, None, f"{attempt}/{name}", df.schema.json()))
    for name, (df, key, buckets) in replaced.items():
        if buckets:
            df.withColumn("bucket", bucket_of(key)).repartition("bucket").write.partitionBy("bucket").parquet(f"{attempt}/{name}")
            manifest += [(batch_id, name, b, f"{attempt}/{name}", df.schema.json()) for b in buckets]
    _make_current(spark, root, manifest)


def _make_current(spark: SparkSession, root: str, manifest: list[tuple]) -> None:
    spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def compact(spark: SparkSession, root: str, name: str, batch_id: int, rows: DataFrame) -> None:
    """``rows``, which say the same as an appended table, take the place of all its folders, so that their number does not only grow.

    ``batch_id`` comes after the batches that the rows were read from, and before those that are to follow. Folders that are not read any more may go once no
    reader is left that began before.
    """
    if is_committed(spark, root, batch_id):
        return
    path = f"{root}/batch-{batch_id}-{uuid.uuid4().hex}/{name}"
    rows.write.parquet(path)
    _make_current(spark, root, [(batch_id, name, WHOLE, path, rows.schema.json())])


def current(spark: SparkSession, root: str, name: str, buckets: list[int] | None = None) -> DataFrame | None:
    """A table as the committed batches left it, or some of its buckets; None before the first batch.

    The manifest has one row a batch and appended table, and one a replaced bucket.
    """
    commits = _commits(spark, root)
    if commits is None:
        return None
    mine = commits.filter(F.col("name") == name)
    if buckets is not None:
        mine = mine.filter(F.col("bucket").isNull() | F.col("bucket").isin([WHOLE, *buckets]))
    last = F.max_by(F.struct("path", "kind", "batch"), F.struct("batch", "path")).alias("last")
    rows = mine.groupBy("bucket", F.when(F.col("bucket").isNull(), F.col("path"))).agg(last).select("bucket", "last.*").collect()
    since = max((r["batch"] for r in rows if r["bucket"] == WHOLE), default=-1)
    plain = [r for r in rows if r["bucket"] == WHOLE or r["bucket"] is None and r["batch"] > since]
    if plain:
        return spark.read.schema(StructType.fromJson(json.loads(plain[-1]["kind"]))).parquet(*[r["path"] for r in plain])
    found = None
    for path in sorted({r["path"] for r in rows}):
        here = [r for r in rows if r["path"] == path]
        kind = StructType.fromJson(json.loads(here[0]["kind"])).add("bucket", IntegerType())
        part = spark.read.schema(kind).option("basePath", path).parquet(path).filter(F.col("bucket").isin([r["bucket"] for r in here])).drop("bucket")
        found = part if found is None else found.unionByName(part)
    return found
