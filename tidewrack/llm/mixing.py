"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / w, from a hash of its identity
and its quality weight w; sorted by it within its source it forms a weighted
random order. Token sizes are summed along that order, and documents are taken up
to the source's token budget. A budget beyond the source's size is met by complete
epochs first, then by one fractional selection, up to the source's cap.

The order is never made in one task: keys fall into ranges of equal width, the sizes
of the ranges (at most RANGES rows per source) are summed first, and only within one
range are documents sorted. A weight is at most 1, so no range is expected to hold more
than 1 / STEPS of a source, whatever the weights, and a source with a third of all rows
is many tasks.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions import unicode as U
from tidewrack.session import Scratch

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: How the public vocabulary of that file splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranges of keys to a key of 1, and in all; the last one holds what is beyond, e ** (-RANGES / STEPS / 4) of a source at most.
STEPS, RANGES = 1024, 65_536
#: The vocabulary is shipped to the executors up to this many bytes.
MAX_VOCABULARY = 64 << 20
SEED = "tidewrack-mix-1"


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str = "text", out: str = "tokens", path: str = f"{TOKENIZERS}/{TOKENIZER}") -> DataFrame:
    """``df`` with the number of tokens of the whole text; null and empty texts have none.

    The vocabulary at ``path`` is read by the driver and shipped to the executors.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer at {path}; give its path")
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} bytes at {path}")
    with open(path, "rb") as file:
        shipped = df.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(shipped.value)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return df.withColumn(out, count(F.col(text)))


def source_name(x: Column) -> Column:
    """A source's name however it is written: lower case, words joined by an underscore; '' where there is none."""
    words = U.squeeze(F.regexp_replace(F.lower(U.lookalikes(U.compatibility(U.visible(x)))), r"[\s_-]+", " "))
    return F.coalesce(F.replace(words, F.lit(" "), F.lit("_")), F.lit(""))


def quality(text: Column) -> Column:
    """A weight of 0.25 to 1: the share of letters, and fewer for very short texts."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))
    share = letters / F.greatest(F.length(text), F.lit(1))
    length = F.least(F.length(text) / F.lit(400.0), F.lit(1.0))
    return F.round(F.lit(0.25) + F.lit(0.5) * F.coalesce(share, F.lit(0.0)) + F.lit(0.25) * F.coalesce(length, F.lit(0.0)), 4)


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per source with a target: size, share, cap, budget, epochs and remainder, in tokens.

    Shares are those of the targets that have tokens, rescaled to one. Without
    ``total`` it is the largest at which every such source keeps its share within
    its cap. Targets without documents get a budget of nought; so do null or negative
    shares. A repeated target counts with its largest share and cap.
    """
    t = targets.groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("cap"))
    has = t.join(sizes, "source", "left").na.fill(0, ["size"]).withColumn("live", (F.col("size") > 0) & (F.col("share") > 0) & (F.col("cap") > 0))
    live = has.where("live").agg(F.sum("share").alias("shares"), F.min(F.col("size") * F.col("cap") / F.col("share")).alias("scale"))
    # One row: the sum of the live shares and the total they allow.
    out = has.crossJoin(F.broadcast(live))
    whole = F.col("scale") * F.col("shares") if total is None else F.lit(float(total))
    budget = F.when(F.col("live"), F.least(whole * F.col("share") / F.col("shares"), F.col("size") * F.col("cap").cast("double"))).otherwise(0.0)
    out = out.withColumn("budget", F.floor(budget + F.lit(1e-6)))
    epochs = F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(F.lit(0))
    out = out.withColumn("epochs", F.least(epochs, F.col("cap").cast("bigint")))
    return out.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size")).select("source", "share", "cap", "size", "budget", "epochs", "rest")


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """(key, source, tokens, copies) of every document in the mixture.

    ``documents`` has the key, text, source and ``tokens``. Documents without tokens,
    and of sources without a target, are not in it. A document is taken at most as
    often as its source's cap; the fractional selection takes whole documents while
    they fit, so it ends less than one document short of the budget. Rows that repeat a key
    count as one row each, ordered by their place in the text's hash.
    """
    scratch = Scratch(documents.sparkSession, "mixture")
    u = (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("key").cast("string")), 256), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))
    known = documents.where("tokens > 0").select(F.col(key).alias("key"), source_name(F.col("source")).alias("source"), "tokens", quality(F.col("text")).alias("weight"), F.xxhash64("text").alias("tie"))
    keyed = scratch.keep(known.withColumn("rank", -F.log(u) / F.col("weight")).withColumn("range", F.least(F.floor(F.col("rank") * STEPS), F.lit(RANGES - 1))))
    ranges = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("held"))
    named = targets.withColumn("source", source_name(F.col("source")))
    planned = scratch.keep(plan(ranges.groupBy("source").agg(F.sum("held").alias("size")), named, total))
    # At most RANGES rows a source.
    before = ranges.withColumn("before", F.sum("held").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["before"])
    placed = keyed.join(before.select("source", "range", "before"), ["source", "range"]).join(F.broadcast(planned.select("source", "epochs", "rest")), "source")
    order = Window.partitionBy("source", "range").orderBy("rank", "key", "tie")
    placed = placed.withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    copies = (F.col("epochs") + (F.col("upto") <= F.col("rest")).cast("int")).cast("int")
    out = placed.select(F.col("key").alias(key), "source", "tokens", copies.alias("copies")).where("copies > 0")
    out._scratch, out._planned = scratch, planned
    return out


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, docs, tokens, share, max_copies): what the mixture holds, beside the targets."""
    held = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("max_copies"))
    whole = held.agg(F.sum("tokens").alias("whole"))
    named = targets.select(source_name(F.col("source")).alias("source"), "target_share")
    out = named.join(held, "source", "full").na.fill(0).crossJoin(F.broadcast(whole))
    return out.select("source", "target_share", "docs", "tokens", F.round(F.col("tokens") / F.greatest(F.coalesce("whole", F.lit(0)), F.lit(1)), 6).alias("share"), "max_copies")
