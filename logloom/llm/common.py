"""What the training-data operators share: tables, the shared folder, written intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Learning folds: rows whose crc32(doc_id as text) leaves remainder 0 are held out.
FOLDS = 5

_OWN: dict[str, str] = {}
#: Paths of written intermediates that nobody has removed yet, by application.
_LEFT: dict[str, set[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process (tests) does a
    temporary folder of this machine stand in; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="logloom-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/logloom/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _LEFT.get(spark.sparkContext.applicationId, set()).discard(path)


def sweep(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete this application's written intermediates, but those in keep.

    A query's intermediates are read until its result is written, so only the caller knows when they may go.
    """
    for path in sorted(_LEFT.get(spark.sparkContext.applicationId, set()) - set(keep)):
        remove(spark, path)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs with each row in one struct column, r, beside further columns: its names then clash with no others."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), *(c.alias(k) for k, c in more.items()))


def unpacked(docs: DataFrame, *but: str) -> list[Column]:
    """The columns of packed rows, in order, but the named ones."""
    return [F.col(f"r.`{f.name}`").alias(f.name) for f in docs.schema["r"].dataType.fields if f.name not in but]


class Written:
    """A DataFrame written to the shared folder: lineage ends there, so lost executors cost no recomputation."""

    def __init__(self, df: DataFrame, tag: str, **metrics: Column):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, tag)
        _LEFT.setdefault(self.spark.sparkContext.applicationId, set()).add(self.path)
        seen = Observation(f"{tag}-{uuid.uuid4().hex}")
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())).write.parquet(self.path)
        self.metrics = seen.get
        self.rows = self.metrics["rows"]
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def remainder(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod FOLDS; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where the id's fold is the held-out one; a null id is not held out (and never learned from)."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def learnable(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id) != 0, F.lit(False))


def settled(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns computed once before what follows.

    A filter on a computed column is pushed through the projections that made
    it, and whatever they share is then worked out again for each mention. A
    generated column stops that.
    """
    once = f"_once_{uuid.uuid4().hex[:8]}"
    out = df.select("*", F.explode_outer(F.array(F.struct(*names))).alias(once))
    return out.select(*(F.col(f"{once}.{c}").alias(c) if c in names else F.col(c) for c in df.columns))
