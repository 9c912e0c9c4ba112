"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators.packed import split_values
from tidewrack.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the four packed fields, with its position."""
    screening = table(spark, sf_dir, "benchmark_validation_blinded", "calibration_record_id", "query_ids", "families", "discovery_systems")
    sponge = table(spark, sf_dir, "ss_mech_feeding_pumping_sponge_01", "paper_id", "authors")
    lists = split_values(screening, F.col("calibration_record_id"), {"query_ids": False, "families": False, "discovery_systems": False})
    return lists.unionByName(split_values(sponge, F.col("paper_id"), {"authors": True}))


QUERIES = {"p2_found": p2_found}
