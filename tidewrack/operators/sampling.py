"""Hash-ordered stratified samples: quota passes, round-robin fill and locked splits, as windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_hash(seed: str, salt: str | Column, key: Column) -> Column:
    """Hex digest that orders rows the same on every run."""
    return F.sha2(F.concat_ws("|", F.lit(seed), salt if isinstance(salt, Column) else F.lit(salt), key), 256)


def top_levels(df: DataFrame, field: str, n: int) -> DataFrame:
    """The ``n`` most frequent levels, ties by label."""
    return df.groupBy(field).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.asc(field)).limit(n)


def ensure_levels(df: DataFrame, field: str, minimum: int, seed: str, key: str, taken: str = "taken", levels: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``taken`` set for as many more rows of each level as it lacks of ``minimum``, in stable order.

    Only the few smallest hashes of a level matter, so each partition keeps its own
    ``minimum`` first (Spark's window-group limit) and a level of a third of all rows
    is not sorted in one task.
    """
    if levels is None:
        asked = df.select(F.col(field).alias("level")).distinct()
    elif isinstance(levels, DataFrame):
        asked = levels.select(F.col(field).alias("level"))
    else:
        asked = df.sparkSession.createDataFrame([(v,) for v in levels], "level string")
    have = df.groupBy(F.col(field).alias("level")).agg(F.count_if(F.col(taken)).alias("have"))
    order = stable_hash(seed, F.concat(F.lit(f"ensure|{field}|"), F.col(field)), F.col(key))
    free = df.where(~F.col(taken)).select(key, F.col(field).alias("level"), order.alias("h"))
    best = free.withColumn("n", F.row_number().over(Window.partitionBy("level").orderBy("h"))).where(F.col("n") <= minimum)
    added = best.join(asked, "level").join(have, "level").where(F.col("n") <= F.lit(minimum) - F.col("have")).select(key, F.lit(True).alias("added"))
    return df.join(added, key, "left").withColumn(taken, F.col(taken) | F.coalesce("added", F.lit(False))).drop("added")


def round_robin(df: DataFrame, fields: Sequence[str], size: int, seed: str, key: str, taken: str = "taken") -> DataFrame:
    """``df`` with ``taken`` filled to ``size`` rows, one of each bucket in turn, buckets and rows in stable order."""
    bucket = F.concat_ws("|", *[F.col(f) for f in fields])
    have = df.agg(F.count_if(taken).alias("have"))
    free = df.where(~F.col(taken)).select(key, bucket.alias("bucket"))
    turn = Window.partitionBy("bucket").orderBy(stable_hash(seed, F.concat(F.lit("bucket|"), F.col("bucket")), F.col(key)))
    ranked = free.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= size)
    # At most ``size`` rows can be added, so the order over buckets needs no more than those.
    first = ranked.withColumn("h", F.sha2(F.concat_ws("|", F.lit(seed), F.col("bucket")), 256)).orderBy("turn", "h").limit(size)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("turn", "h"))).crossJoin(F.broadcast(have)).where(F.col("place") <= F.lit(size) - F.col("have"))
    return df.join(placed.select(key, F.lit(True).alias("added")), key, "left").withColumn(taken, F.col(taken) | F.coalesce("added", F.lit(False))).drop("added")


def numbered(df: DataFrame, order: Column, out: str, pattern: str = "CAL-%04d") -> DataFrame:
    """A bounded sample with ids in stable order."""
    return df.withColumn(out, F.format_string(pattern, F.row_number().over(Window.orderBy(order))))


def locked_split(df: DataFrame, n: int, seed: str, key: str, salt: str = "validation-split", out: str = "split") -> DataFrame:
    """The first ``n`` rows in stable order are VALIDATION, the others DEVELOPMENT.

    The first ``n`` are found as a top-k, never by one global sort.
    """
    first = df.select(key, stable_hash(seed, salt, F.col(key)).alias("h")).distinct().orderBy("h").limit(n).select(key, F.lit("VALIDATION").alias(out))
    return df.join(F.broadcast(first) if n <= 100_000 else first, key, "left").withColumn(out, F.coalesce(out, F.lit("DEVELOPMENT")))
