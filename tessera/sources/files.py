"""Files as tables: text by name, JSON lines, settings, and documents with what their bytes say they are."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.containers import container_verdict

MAX_UPLOAD = 4 * 1024 * 1024
#: Extensions and media types (fixed values).
TYPES = (
    ("pdf", "application/pdf"),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("doc", "application/msword"),
)
#: Seconds that settings are held for.
SETTINGS_SECONDS = 300
_SETTINGS: dict[str, tuple[float, dict]] = {}


def _stem(path) -> F.Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _empty(spark: SparkSession, path: str) -> DataFrame:
    """path of the empty files that a path or pattern names, or that lie in the folders it names; Spark's readers list none.

    The driver lists names, as it does for any read.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for s in fs.globStatus(at) or [] for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    names = [f.getPath().toString() for f in found if f.isFile() and f.getLen() == 0 and f.getPath().getName()[:1] not in "._"]
    return spark.createDataFrame([(n,) for n in names], "path string")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """key, text: whole files by their names without extension; a file is one row, an empty one an empty text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.unionByName(_empty(spark, path).withColumn("text", F.lit(""))).select(_stem(F.col("path")).alias("key"), "text")


def settings(spark: SparkSession, path: str, now: float | None = None) -> dict:
    """A JSON file's object, held for SETTINGS_SECONDS; empty where there is no file or no object in it."""
    now = time.monotonic() if now is None else now
    held = _SETTINGS.get(path)
    if held and now - held[0] < SETTINGS_SECONDS:
        return dict(held[1])
    try:
        found = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    except Exception as e:  # no file, or no JSON in it
        if not isinstance(e, ValueError) and "PATH_NOT_FOUND" not in str(e):
            raise
        found = {}
    _SETTINGS[path] = now, found if isinstance(found, dict) else {}
    return dict(_SETTINGS[path][1])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines by a given schema, without a pass to infer one; broken lines are in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Nulls are written, so that what is read has the same columns."""
    df.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, size, media_type, verdict: accepted, empty, too_large, unsupported, encrypted or invalid.

    A file's container has to be what its extension says and to hold together. Only files of a known kind within
    MAX_UPLOAD are read; of all others their names and sizes are looked at. Contents aren't converted to text.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    media = F.create_map(*[F.lit(x) for row in TYPES for x in row])
    known = media[extension].isNotNull()
    fits = known & F.col("length").between(1, MAX_UPLOAD)
    files = spark.read.format("binaryFile").load(path)
    empty = _empty(spark, path).select("path", F.lit(0).cast("long").alias("length"), F.when(~known, "unsupported").otherwise("empty").alias("verdict"))
    # The filter on length reaches the scan, which then leaves larger files alone.
    read = files.where(F.col("length").between(1, MAX_UPLOAD)).where(fits).select("path", "length", container_verdict(extension, "content").alias("verdict"))
    unread = files.select("path", "length").where(~fits).withColumn("verdict", F.when(~known, "unsupported").otherwise("too_large"))
    return read.unionByName(unread).unionByName(empty).select("path", extension.alias("extension"), F.col("length").alias("size"), media[extension].alias("media_type"), "verdict")
