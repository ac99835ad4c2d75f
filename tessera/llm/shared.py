"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of tables that cut() wrote and nobody deleted yet.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where the setting is absent (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, drop: list[DataFrame] | None = None) -> DataFrame:
    """df, computed once and written to the shared folder; its lineage ends there and survives lost executors.

    drop: earlier results of cut() that nothing reads any more; their files go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    _MADE.append(path)
    for old in drop or []:
        release(old)
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a result of cut()."""
    _delete(df.sparkSession, df.cut_path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _MADE:
        _MADE.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what cut() wrote inside the block, at its end, but for results put into the list it gives.

    An operator's result reads tables of cut(), so it has to be used up, or be cut and kept, inside.
    """
    before, keep = set(_MADE), []
    try:
        yield keep
    finally:
        kept = {df.cut_path for df in keep}
        for path in [p for p in _MADE if p not in before and p not in kept]:
            _delete(spark, path)


def packed(df: DataFrame) -> Column:
    """All columns of df as one, `row`, so that no name of theirs can clash; select("row.*") brings them back."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")


def salted(rows: DataFrame, groups: DataFrame, key: str, n: str, spread: Column, salts: int = 64, hot: int = 4000) -> DataFrame:
    """rows joined with groups (one row per key, n: rows that bear it), the rows of hot keys over `salts` tasks by a hash of `spread`.

    A key is hot from total / hot rows on, so at most `hot` keys are; they are broadcast.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    often = groups.where((F.col(n) > salts) & (F.col(n) * hot >= total)).select(key, F.lit(salts).alias("_salts"))
    salt = lambda x: F.coalesce("_salts", F.lit(1)) if x is None else F.coalesce(F.pmod(F.xxhash64(x), F.col("_salts")), F.lit(0)).cast("int")
    left = rows.join(F.broadcast(often), key, "left").withColumn("_salt", salt(spread)).drop("_salts")
    right = groups.join(F.broadcast(often), key, "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salt(None) - 1))).drop("_salts")
    return left.join(right.hint("merge"), [key, "_salt"]).drop("_salt")


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over, which otherwise stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
