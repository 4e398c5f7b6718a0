"""Small helpers that several operators share: size-checked broadcasts, hot keys, table access."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heartloom.lineage import cut, shared_folder

__all__ = ["cut", "table", "small", "light", "hot_keys", "dealt", "spread", "bounded_batches", "shared_place", "SALT"]

#: Bytes of a wider table that may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Rows of narrow (id, id) pairs that may be broadcast; a hashed relation of them stays under about 32 MB.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_place(spark: SparkSession, name: str) -> str:
    """A path in the folder that all share (``lineage.shared_folder``) that nobody uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch where the session sets no bound of its own.
ARROW_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, where the session doesn't, for stages that read whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(ARROW_BYTES))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a cut or cheap narrow table if it has at most this many rows; else leave the shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def light(df: DataFrame, size: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a cut table whose rows' sizes (a column of bytes) add up to this at most."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


#: Column that spreads the rows of a hot key over several tasks.
SALT = "__salt"


def hot_keys(counts: DataFrame, key: str, rows: int, parts: int = 1000) -> DataFrame:
    """(key, __splits) of the keys that have more than 1/parts of all rows, of counts (key, n).

    There are fewer of them than parts, whatever the data, so they are broadcast. A key is split into as many pieces as
    leave each about 1/parts of the rows. Null keys are never among them, as they join nothing.
    """
    each = max(1, rows // parts)
    return F.broadcast(cut(counts.filter(F.col(key).isNotNull() & (F.col("n") > each)).select(key, F.ceil(F.col("n") / each).cast("int").alias("__splits"))))


def dealt(rows: DataFrame, hot: DataFrame, key: str, *by: str) -> DataFrame:
    """rows with a salt: 0 for most keys, one of its pieces for a row of a hot key, drawn by hash of the columns by."""
    out = rows.join(hot, key, "left")
    return out.withColumn(SALT, F.coalesce(F.pmod(F.xxhash64(*by), F.col("__splits").cast("long")).cast("int"), F.lit(0))).drop("__splits")


def spread(groups: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """groups (a row for each key) with a copy for each piece of a hot key, to be joined to dealt rows on key and salt."""
    out = groups.join(hot, key, "left")
    return out.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce("__splits", F.lit(1)) - 1))).drop("__splits")
