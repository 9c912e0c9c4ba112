"""Visually identical text with different characters, brought to one form.

Look-alike, full-width, styled, ligature and invisible characters and blanks are
mapped to ordinary ones; the mapped values are grouped in SQL under the
case- and accent-sensitive Unicode collation, which takes composed and combining
accents for the same; of every class one member is chosen as canonical and
joined back to all.

Classes are found from distinct values merged map-side, so
a value that a third of all rows share is one row before the first shuffle. Pairs
of records come from pairs of different *values*, never from all pairs of a class.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import unicode as U
from tidewrack.session import Scratch

# Marks and what they look like.
MARKS = {
    "‐": "-", "‑": "-", "−": "-", "﹘": "–", "ʼ": "’", "՚": "’", "＇": "'", "ʹ": "'", "‚": ",", "٫": ",", "ǃ": "!", "։": ":", "׃": ":", "∶": ":", "ꓸ": ".", "․": ".",
}
# Characters that stand for several; and the Roman numerals, by rule.
SEVERAL = {"‼": "!!", "⁇": "??", "⁈": "?!", "⁉": "!?", "…": "...", "‥": ".."} | {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2160, 0x2180)}


def _expanded(x: Column) -> Column:
    for char, plain in SEVERAL.items():
        x = F.replace(x, F.lit(char), F.lit(plain))
    return x


def look(x: Column) -> Column:
    """The text as it reads: look-alikes mapped, every blank a space, invisible characters gone.

    Letters, case, accents, marks and spacing stay, outer blanks included.
    """
    source = "".join(MARKS)

    def every(v: Column) -> Column:
        out = F.translate(U.lookalikes(U.compatibility(F.regexp_replace(U.visible(v), r"[\p{Zs}\u0085\u2028\u2029]", " "))), source, "".join(MARKS.values()))
        return U.let(out, lambda t: F.when(t.rlike("[" + "".join(SEVERAL) + "]"), _expanded(t)).otherwise(t))

    return F.translate(U.beyond_ascii(x, every), "\t\u000b\u000c\u0000", "   ")


def coarse(x: Column) -> Column:
    """A binary key that values of one class share: the ASCII letters and digits of a look, without case and accents."""
    return F.xxhash64(F.regexp_replace(F.lower(U.beyond_ascii(x, U.without_accents)), "[^a-z0-9]", ""))


def looks(values: DataFrame, shared: bool = False) -> DataFrame:
    """(field, value, canonical, members) of every distinct value of ``values`` (field, value).

    The canonical member is the value of its class that is its own look if there is
    one, else the one with the fewest characters beyond ASCII, then the shortest,
    then the smallest by code point. Null values are left out; an empty value is its own class. With
    ``shared`` only values are compared that another one may equal: those whose
    coarse key is not theirs alone, found by plain hashing.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "classes")
    seen = values.where("value is not null").select("field", "value").distinct().withColumn("look", look(F.col("value")))
    if shared:
        # Looks are dear: of every value once for its key, then again only of those that meet another one.
        keyed = scratch.keep(seen.select("field", "value", coarse(F.col("look")).alias("coarse")))
        several = keyed.groupBy("field", "coarse").agg(F.count("*").alias("n")).where("n > 1").select("field", "coarse")
        seen = keyed.join(several, ["field", "coarse"], "left_semi").select("field", "value").withColumn("look", look(F.col("value")))
    seen = scratch.keep(seen.withColumn("plain", (F.col("value") != F.col("look")).cast("int")).withColumn("odd", F.length(F.regexp_replace("value", r"[\x00-\x7f]", ""))).withColumn("size", F.length("value")))
    view = f"looks_{id(seen)}"
    seen.createOrReplaceTempView(view)
    classes = spark.sql(f"SELECT field, look COLLATE UNICODE AS class, min(struct(plain, odd, size, value)) AS best, count(*) AS members FROM {view} GROUP BY field, look COLLATE UNICODE")
    keyed = spark.sql(f"SELECT field, value, look COLLATE UNICODE AS class FROM {view}")
    spark.catalog.dropTempView(view)
    out = keyed.join(classes, ["field", "class"]).select("field", "value", F.col("best.value").alias("canonical"), "members")
    out._scratch = scratch
    return out


def canonical_values(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``<column>_canonical`` for every named column: one form per look. Nulls stay null."""
    for c in columns:
        found = looks(df.select(F.lit(c).alias("field"), F.col(f"`{c}`").alias("value"))).select(F.col("value").alias(f"{c}__value"), F.col("canonical").alias(f"{c}_canonical"))
        df = df.join(found, F.col(f"`{c}`") == F.col(f"{c}__value"), "left").drop(f"{c}__value")
    return df


def alike_pairs(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(<key>_a, <key>_b, field_name): two rows whose values read alike but are not the same string, smaller key first.

    Null and blank values are in no pair, nor is a row with itself; repeated rows
    change nothing.
    """
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("value")) for c in columns])).alias("f")
    long = df.select(F.col(key).alias("key"), both).select("key", "f.field", "f.value").where("key is not null and trim(value) <> ''")
    scratch = Scratch(df.sparkSession, "looks")
    classes = looks(long, shared=True).where("members > 1")
    # Joined on by 128-bit digests, so that no two values are taken for one.
    digest = lambda v: F.unhex(F.md5(F.concat_ws("|", "field", v)))
    seen = scratch.keep(classes.select("field", "value", digest("canonical").alias("class"), digest("value").alias("value_id")))
    named = long.join(seen.select("field", "value", "value_id"), ["field", "value"]).select("key", "field", "value_id")
    pairs = seen.select("class", F.col("value_id").alias("va")).join(seen.select("class", F.col("value_id").alias("vb")), "class").where("va < vb").select("va", "vb")
    left = named.select(F.col("key").alias("ka"), "field", F.col("value_id").alias("va"))
    right = named.select(F.col("key").alias("kb"), F.col("value_id").alias("vb"))
    found = pairs.join(left, "va").join(right, "vb").where("ka <> kb")
    out = found.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"), F.col("field").alias("field_name"))
    out._scratch = scratch
    return out


def alike_classes(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(<key>, field_name, canonical): rows whose value reads like another string, under their class's canonical form.

    One row for each such row and field, where ``alike_pairs`` has one for every two.
    """
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("value")) for c in columns])).alias("f")
    long = df.select(F.col(key).alias("key"), both).select("key", "f.field", "f.value").where("key is not null and trim(value) <> ''")
    found = looks(long, shared=True)
    out = long.join(found.where("members > 1"), ["field", "value"]).select(F.col("key").alias(key), F.col("field").alias("field_name"), "canonical").distinct()
    out._scratch = found
    return out
