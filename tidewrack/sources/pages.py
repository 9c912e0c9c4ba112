"""Saved result pages of the search services, read as JSON in parallel and checked.

The network part of a search is not the engine's. A client saves one JSON object a
file; pages of three kinds are read: offset pages (``meta.count`` or ``count``, and
``results``), token pages (``total``, ``token`` and ``data``) and web results
(``query_id`` and ``results``, ranked from 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = "count bigint, total bigint, token string, query_id string, meta struct<count: bigint>, results array<string>, data array<string>"


def read_pages(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """(page, ordinal, reported, token, query_id, result_rank, id, payload): one row per result; a page without any gives none."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("page"), F.from_json("value", _PAGE).alias("p"))
    items = F.coalesce("p.results", "p.data", F.array().cast("array<string>"))
    rows = whole.select("page", F.coalesce("p.count", "p.meta.count", "p.total").alias("reported"), "p.token", "p.query_id", F.posexplode(items).alias("ordinal", "payload"))
    return rows.select("page", "ordinal", "reported", "token", "query_id", (F.col("ordinal") + 1).alias("result_rank"), F.get_json_object("payload", f"$.{key}").alias("id"), "payload")


def page_faults(pages: DataFrame) -> DataFrame:
    """(rows, reported, repeated): one row if a search's pages do not hold what it reports, each id once; else none."""
    seen = pages.agg(F.count("*").alias("rows"), F.max("reported").alias("reported"), (F.count("id") - F.countDistinct("id")).alias("repeated"))
    return seen.where("repeated > 0 or (reported is not null and rows <> reported)")


def checked(pages: DataFrame) -> DataFrame:
    """``pages``, or an error where they are not the whole search."""
    fault = page_faults(pages).first()
    if fault:
        raise ValueError(f"{fault.rows} rows of {fault.reported} reported, {fault.repeated} ids repeated")
    return pages
