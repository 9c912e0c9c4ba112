"""Queries of the llm operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.groups import link_groups, record_keys
from tidewrack.llm.leakage import leaked_items
from tidewrack.llm.lookalike import alike_pairs
from tidewrack.llm.mixing import mixture, reached, token_counts
from tidewrack.llm.names import author_pairs, entries, trimmed
from tidewrack.llm.sample import BUCKETS, SEED, bucket, place, sample_key, stable_sample
from tidewrack.llm.sentences import split_sentences
from tidewrack.llm.survivors import survivors
from tidewrack.operators.packed import split_values
from tidewrack.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that shares a work with another, under the smallest id of its group."""
    records = table(spark, sf_dir, "records", "occurrence_id", "title", "doi", "url")
    return link_groups(record_keys(records))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record whose doi, abstract and full-text status survive, per group of p1_found."""
    records = table(spark, sf_dir, "records", "occurrence_id", "system", "doi", "abstract_or_snippet", "full_text_status", "retrieved_date")
    return survivors(records, p1_found(spark, sf_dir)).select("group_id", "field_name", "occurrence_id")


def p3_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_found, but among real values the greatest posterior survives, not the stated order."""
    records = table(spark, sf_dir, "records", "occurrence_id", "system", "doi", "abstract_or_snippet", "full_text_status", "retrieved_date")
    chosen = survivors(records, p1_found(spark, sf_dir), prior="votes")
    return chosen.select("group_id", "field_name", "occurrence_id", F.round("posterior", 6).alias("posterior"))


SHARE = 0.1


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the screening records that keeps its members as rows arrive or repeat."""
    rows = table(spark, sf_dir, "benchmark_validation_blinded", "corpus_id", "calibration_record_id")
    key = sample_key(F.col("corpus_id"), F.col("calibration_record_id"))
    return stable_sample(rows, key, SHARE).select(key.alias("sample_key"), "calibration_record_id", "sample_bucket", "sample_place").distinct()


def p4_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the sample per share: each share holds all of the smaller ones."""
    rows = table(spark, sf_dir, "benchmark_validation_blinded", "corpus_id", "calibration_record_id")
    keys = rows.select(sample_key(F.col("corpus_id"), F.col("calibration_record_id")).alias("k")).where("k is not null").distinct()
    at = place(bucket(F.col("k"), SEED), SEED)
    shares = [0.01, 0.05, 0.1, 0.2, 0.5, 1.0]
    counts = [F.count_if(at < round(BUCKETS * s)).alias(f"in_{round(100 * s)}_percent") for s in shares]
    return keys.agg(*counts)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    documents = token_counts(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixture(documents, targets), targets


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the mixture that were reached."""
    return reached(*_mixed(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different spellings of one author, over records and the sponge table."""
    records = table(spark, sf_dir, "records", "authors", "system")
    sponge = table(spark, sf_dir, "ss_mech_feeding_pumping_sponge_01", "paper_id", "authors")
    values = split_values(sponge, F.col("paper_id"), {"authors": True}).select(F.col("value").alias("name"))
    return author_pairs(entries(records).unionByName(trimmed(values)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records whose title or authors read alike but differ as strings."""
    return alike_pairs(table(spark, sf_dir, "records", "occurrence_id", "title", "authors"), "occurrence_id", "title", "authors")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold two fifths of a test item, with the item."""
    documents, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text")
    return leaked_items(documents, items).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document, by code-point offsets."""
    return split_sentences(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_votes": p3_votes, "p4_sample": p4_sample, "p4_nested": p4_nested, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found}
_STEP, _SHIFT = (int.from_bytes(SEED.encode()[:3], "big") | 1) % BUCKETS, len(SEED) * 7919
_KEYS = """select distinct calibration_record_id, coalesce('C:' || nullif(regexp_replace(upper(coalesce(corpus_id, '')), '[^A-Z0-9]', '', 'g'), ''), 'R:' || nullif(regexp_replace(upper(coalesce(calibration_record_id, '')), '[^A-Z0-9]', '', 'g'), '')) as sample_key from benchmark_validation_blinded"""
_PLACED = f"select *, ('0x' || sha256('{SEED}|' || sample_key)[1:4])::int as sample_bucket, (('0x' || sha256('{SEED}|' || sample_key)[1:4])::bigint * {_STEP} + {_SHIFT}) % {BUCKETS} as sample_place from ({_KEYS}) where sample_key is not null"
_NESTED = ", ".join(f"count_if(sample_place < {round(BUCKETS * s)})::bigint as in_{round(100 * s)}_percent" for s in (0.01, 0.05, 0.1, 0.2, 0.5, 1.0))
SQL: dict[str, str] = {"p4_nested": f"select {_NESTED} from (select distinct sample_key, sample_place from ({_PLACED}))", "p4_sample": f"select sample_key, calibration_record_id, sample_bucket, sample_place from ({_PLACED}) where sample_place < {round(BUCKETS * SHARE)}"}
