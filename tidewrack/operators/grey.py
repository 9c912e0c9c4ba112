"""Results of web searches: domains, enrichment with a model's answers, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of an answer and what a record without one is marked with.
ANSWER = ("document_type", "issuing_organization", "publication_year", "language", "full_document_guess")
ANSWERED, UNANSWERED = "unverified_descriptive_metadata", "missing_from_model_response"


def domain_frequency(results: DataFrame, order: str) -> DataFrame:
    """(domain, occurrences, first): domains by frequency, equals as first seen by ``order``; blank ones are dropped."""
    return results.where("domain <> ''").groupBy("domain").agg(F.count("*").alias("occurrences"), F.min(order).alias("first"))


def first_by(results: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every ``key``; merged map-side, so a hot key is no hot task."""
    return results.groupBy(key).agg(F.min_by(F.struct("*"), order).alias("r")).select("r.*")


def batches(unique: DataFrame, order: str, size: int) -> DataFrame:
    """``unique`` with ``batch`` and the ``id`` within it, ``size`` to a batch in the order given."""
    from tidewrack.sources.files import occurrence_ids

    placed = occurrence_ids(unique, [order])
    return placed.withColumn("batch", F.floor(F.col("occ_idx") / size).cast("long")).withColumn("id", (F.col("occ_idx") % size).cast("string")).drop("occ_idx")


def enrich(results: DataFrame, asked: DataFrame, answers: DataFrame) -> DataFrame:
    """``results`` with the answer to their url, one for all rows of it; an unanswered one is marked and has empty fields.

    ``asked`` is (url, batch, id), ``answers`` (batch, id, place and the fields of an
    answer); of several answers under one id the last counts.
    """
    last = answers.groupBy("batch", "id").agg(F.max_by(F.struct(*ANSWER), "place").alias("a"))
    told = asked.join(last, ["batch", "id"], "left").select("url", *[F.coalesce(F.col(f"a.{f}").cast("string"), F.lit("")).alias(f"answer_{f}") for f in ANSWER], F.when(F.col("a").isNotNull(), ANSWERED).otherwise(UNANSWERED).alias("answer_status"))
    return results.join(told, "url")


def usage(responses: DataFrame, column: str = "usage") -> DataFrame:
    """(name, total) of the numbers in every response's usage map."""
    return responses.select(F.explode(column).alias("name", "value")).select("name", F.col("value").try_cast("double").alias("value")).where("value is not null").groupBy("name").agg(F.sum("value").alias("total"))


def grey_status(archived: Column, guess: Column) -> Column:
    """Full-text status of a web result: archived, likely a whole document, or nothing."""
    return F.when(F.coalesce(archived, F.lit("")) != "", "ARCHIVED").when(F.lower(F.trim(F.coalesce(guess, F.lit("")))).isin("true", "yes", "y", "1"), "LIKELY_FULL_DOCUMENT_URL").otherwise("NOT_IDENTIFIED")


def row_faults(results: DataFrame) -> DataFrame:
    """(query_id, url, faults) of rows that lack a required field or whose excerpt is too long or of several lines."""
    from tidewrack.operators.export import violations

    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    rules = {"query_id": filled(F.col("query_id")), "url": filled(F.col("url")), "title": filled(F.col("title")), "content_length": F.length(F.coalesce("content", F.lit(""))) <= 600, "content_lines": ~F.coalesce("content", F.lit("")).rlike(r"[\r\n]")}
    return results.select("query_id", "url", F.array_join(violations(rules), ",").alias("faults")).where("faults <> ''")


def grey_qa(broad: DataFrame, targeted: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row of counts and checks of the searches."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    urls = enriched.agg(F.count("*").alias("enriched_rows"), F.countDistinct("url").alias("unique_urls"))
    faults = row_faults(broad.select("query_id", "url", "title", "content").unionByName(targeted.select("query_id", "url", "title", "content"))).agg(F.count("*").alias("faults"))
    one = n(broad, "broad_rows").crossJoin(n(targeted, "targeted_rows")).crossJoin(urls).crossJoin(faults)  # four rows of one
    return one.withColumn("counts_reconcile", F.col("enriched_rows") == F.col("broad_rows") + F.col("targeted_rows")).withColumn("rows_valid", F.col("faults") == 0).withColumn("both_phases_have_rows", (F.col("broad_rows") > 0) & (F.col("targeted_rows") > 0))
