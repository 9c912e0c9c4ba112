"""Reproducible sample that stays stable as data grows: nested hash buckets.

Every key belongs for good to one of many fine buckets, by a hash of the key
alone. A fixed permutation orders the buckets, and a sample is an append-only
list of them: the first n of the permutation. So membership depends on the key
only; it is the same on every rerun and partitioning, a selected record stays
selected when rows arrive, repeat or load late, and a larger sample holds every
smaller one. Nothing is shuffled to draw it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import unicode as U

#: Fine buckets; fixed for good, as everything drawn depends on it.
BUCKETS = 65_536
SEED = "tidewrack-sample-1"


def sample_key(corpus_id: Column, record_id: Column) -> Column:
    """The lasting key of a row: its corpus id however typed, else its record id; null if it has neither."""
    norm = lambda x: F.nullif(F.regexp_replace(F.upper(U.compatibility(x)), r"[^\p{L}\p{N}]", ""), F.lit(""))
    return F.coalesce(F.concat(F.lit("C:"), norm(corpus_id)), F.concat(F.lit("R:"), norm(record_id)))


def bucket(key: Column, seed: str = SEED) -> Column:
    """The fine bucket of a key, 0 to BUCKETS - 1, from a hash any engine has."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + "|"), key), 256), 1, 4), 16, 10).cast("int")


def place(bucket_: Column, seed: str = SEED) -> Column:
    """Where a bucket stands in the fixed permutation: an odd multiple and a shift, modulo the power of two."""
    step, shift = (int.from_bytes(seed.encode()[:3], "big") | 1) % BUCKETS, len(seed) * 7919
    return F.pmod(bucket_ * F.lit(step) + F.lit(shift), F.lit(BUCKETS)).cast("int")


def stable_sample(df: DataFrame, key: Column, share: float | None = None, buckets: int | None = None, seed: str = SEED) -> DataFrame:
    """Rows of ``df`` whose bucket is on the list, with ``sample_bucket`` and ``sample_place``.

    Give a ``share`` or a number of ``buckets``; a later call with more of either
    only adds. Rows with a null key have no lasting identity and are left out.
    Existing columns of these two names are replaced.
    """
    n = buckets if buckets is not None else round(BUCKETS * float(share))
    drawn = df.withColumn("sample_bucket", bucket(key, seed))
    drawn = drawn.withColumn("sample_place", place(F.col("sample_bucket"), seed))
    return drawn.where(F.col("sample_place") < F.lit(max(0, min(BUCKETS, n))))


def enough_buckets(df: DataFrame, key: Column, rows: int, before: int = 0, seed: str = SEED) -> int:
    """How long the list must be for at least ``rows`` distinct keys of ``df``, never shorter than ``before``.

    The list so found is append-only: pass the length in use as ``before`` when data has
    grown. Counts of the BUCKETS fixed buckets come to the driver, nothing else.
    """
    counted = df.select(key.alias("k")).where("k is not null").distinct().groupBy(place(bucket(F.col("k"), seed), seed).alias("p")).count().collect()
    per = {r["p"]: r["count"] for r in counted}
    total = n = 0
    while n < BUCKETS and (total < rows or n < before):
        total += per.get(n, 0)
        n += 1
    return n
