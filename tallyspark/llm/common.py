"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; others, whatever their names, are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the session's folder if it names one, else one of our own in local mode (tests).

    A cluster has to name a folder that its executors share.
    """
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyspark-checkpoint-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name beside the checkpoints, which all executors and the driver share."""
    checkpoints(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def among(rows: DataFrame, key: Column, wanted: DataFrame, bits: int) -> DataFrame:
    """rows without most of those whose key, a 64-bit hash, is not in the one column of wanted: a bitmap of so many bits is sent to the tasks."""
    last = F.lit(bits - 1)
    words = wanted.select(F.col(wanted.columns[0]).bitwiseAND(last).alias("__at")).groupBy(F.shiftright("__at", 6).alias("__word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(__at & 63 as int))")).alias("__bits"))
    held = words.groupBy(F.shiftright("__word", 4).alias("__row")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("__word") % 16).cast("int").alias("i"), "__bits"))).alias("__map"))
    held = held.select("__row", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.try_element_at("__map", i), F.lit(0).cast("bigint"))).alias("__words"))
    at = key.bitwiseAND(last)
    found = rows.join(F.broadcast(held), F.shiftright(at, 10) == F.col("__row"))
    word = F.get("__words", F.shiftright(at, 6).bitwiseAND(F.lit(15)).cast("int"))
    return found.where(F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("__row", "__words")


def hand_back() -> None:
    """Gives memory that a Python worker has freed back to the system at the end of a task, where the C library can: the worker lives on."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
