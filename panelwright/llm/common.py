"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every internal column, so that no column of the input clashes.
TMP = "__pw_"

#: Rows in one Arrow batch: a batch of long texts has to fit a Python worker.
BATCH_ROWS = 500

#: Rows of partial sums that one task adds up.
FAN_IN = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, for tables that cut lineage.

    ``spark.checkpoint.dir`` names it on a cluster. Where that is unset, a session on one
    machine (master ``local[...]``) gets a temporary folder of its own; any other session
    has to name one, as its executors would not see the driver's.
    """
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(context, "_panelwright_folder", None)
        if base is None:
            base = context._panelwright_folder = tempfile.mkdtemp(prefix="panelwright-")
    return f"{base.rstrip('/')}/panelwright/{context.applicationId}"


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table survives lost executors; ``drop`` deletes it, or else the JVM when the
    session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    files, place = _at(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._panelwright_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made, once all that reads them was written."""
    for t in tables:
        path = getattr(t, "_panelwright_path", None)
        if path:
            files, place = _at(t.sparkSession, path)
            files.delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_panelwright_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    place = Path(tempfile.mkdtemp(prefix="panelwright-")) / "panelwright.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(place))
    context._panelwright_shipped = True


def bounded_batches(spark: SparkSession) -> None:
    """Make the session ready for Python workers: they get the package, and Arrow batches
    hold ``BATCH_ROWS`` rows unless the session asks for less."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def add_up(rows: DataFrame, part, kind: type, parts: int | None = None) -> dict[str, np.ndarray]:
    """Arrays by key, added up over ``rows``. ``part`` maps a partition's batches to rows
    (part, key, sums): the partition's number, a key and the bytes of its sums. ``FAN_IN``
    of them at a time are added by executors, in as many rounds as ``parts`` partitions
    need, so that the driver gets one row for each key."""
    schema = "part long, key string, sums binary"

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s, kind) for s in parts["sums"])
        return pd.DataFrame({"part": [int(parts["part"].min()) // FAN_IN], "key": [str(parts["key"].iloc[0])], "sums": [total.tobytes()]})

    left, sums = parts or rows.rdd.getNumPartitions(), rows.mapInPandas(part, schema)
    while left > 1:
        sums = sums.groupBy("key", F.floor(F.col("part") / FAN_IN)).applyInPandas(add, schema)
        left = -(-left // FAN_IN)
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found[r["key"]] = found.get(r["key"], 0) + np.frombuffer(r["sums"], kind)
    return found


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does that faster for ASCII texts."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def string_array(items) -> Column:
    items = list(items)
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def sha256(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def split_fold(column: str) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 4; 2 is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)), F.lit(0)).cast("int")
