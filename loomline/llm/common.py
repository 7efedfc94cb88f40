"""Shared helpers of the training-data operators: shared storage, text tokens, counting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular expression class.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\v\f\r"

_fallback: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one where that is unset and driver and executors are one machine."""
    global _fallback
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _fallback is None:
        _fallback = "file://" + tempfile.mkdtemp(prefix="loomline-")
    return _fallback


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and no executor's loss matters."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path).withMetadata(df.columns[0], {"loomline.path": path})


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that stored() made."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.schema[0].metadata["loomline.path"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, n: int):
    """crc32 of a column's text form, mod n (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def source_rows(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no extra column of the input can clash with a computed one."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before each until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out
