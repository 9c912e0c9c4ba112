"""The calibration sample: prepared rows, quota passes, round-robin fill, locked split, blinded set and key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions import text as X
from tidewrack.operators import sampling

# The families in order, the quota passes, the fields of a bucket, and the words of both signals.
FAMILY_ORDER = ("SED_SUSPENDED", "SED_DEPOSITION", "SED_DRILLING", "SED_DREDGING", "SED_TAILINGS", "MECH_FEEDING_MUCUS_CORAL", "MECH_FEEDING_PUMPING_SPONGE", "RESP_THRESHOLD_RECOVERY")
PASSES = (("primary_family", 8), ("system_stratum", 8), ("signal_tier", 20), ("metadata_stratum", 20), ("full_text_bin", 15), ("document_type_stratum", 5))
BUCKET = ("primary_family", "system_stratum", "signal_tier", "metadata_stratum", "full_text_bin")
COMMON_TYPES, TEXT_CHARS, SIZE, VALIDATION = 12, 1200, 400, 100
ORGANISM = "coral|corals|octocoral|gorgonian|sea pen|sea pens|pennatul|scleractin|lophelia|desmophyllum|madrepora|solenosmilia|sponge|sponges|porifera"
STRESSOR = "sediment|sedimentation|suspended solids|turbidity|turbid|burial|buried|smother|dredg|drill cuttings|drilling mud|resuspension|resuspended|tailings|particle loading|sediment plume"
HUMAN = ("human_decision", "human_reason_code", "human_rationale", "human_screening_source", "human_confidence", "human_needs_full_text", "reviewer", "review_date", "review_notes")


def whole_word(words: str) -> str:
    """A pattern of whole words, where letters, digits and the underscore of any script make up words."""
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])"


def signal_tier(text: Column) -> Column:
    o, s = text.rlike(whole_word(ORGANISM)), text.rlike(whole_word(STRESSOR))
    return F.when(o & s, "ORGANISM_AND_STRESSOR").when(o, "ORGANISM_ONLY").when(s, "STRESSOR_ONLY").otherwise("NEITHER_SIGNAL")


def system_stratum(systems: Column) -> Column:
    """The stratum of a pipe list of systems."""
    held = X.split_pipe(systems, squeeze=False)
    has = lambda s: F.array_contains(held, s)
    return (
        F.when(has("Grey literature"), "GREY_LITERATURE").when(has("Web of Science"), "WEB_OF_SCIENCE").when(has("Citation chaining"), "CITATION_CHAINING")
        .when(has("OpenAlex") & has("Semantic Scholar"), "MULTI_SCHOLARLY").when(has("OpenAlex"), "OPENALEX").when(has("Semantic Scholar"), "SEMANTIC_SCHOLAR").otherwise("OTHER")
    )


def primary_family(families: Column, key: Column, seed: str) -> Column:
    """The known family of a pipe list with the smallest hash, else OTHER."""
    held = F.array_intersect(X.split_pipe(families, squeeze=False), F.array(*map(F.lit, FAMILY_ORDER)))
    best = F.array_min(F.transform(held, lambda f: F.struct(F.sha2(F.concat_ws("|", F.lit(f"{seed}|family"), key, f), 256).alias("h"), f.alias("f"))))["f"]
    return F.coalesce(best, F.lit("OTHER"))


def prepare(rows: DataFrame, seed: str, key: str = "corpus_id") -> DataFrame:
    """``rows`` with what the sample is stratified by; a text beyond ``TEXT_CHARS`` is cut for screening and marked so.

    A missing document type is MISSING, a blank one empty.
    """
    empty = F.lit("")
    text = X.strip(F.col("abstract_or_snippet"))
    kind = F.coalesce(F.nullif(F.col("document_type"), empty), F.lit("MISSING"))
    return rows.withColumns({
        "screening_text": F.substring(text, 1, TEXT_CHARS), "text_truncated": F.length(text) > TEXT_CHARS, "primary_family": primary_family(F.col("families"), F.col(key), seed), "system_stratum": system_stratum(F.col("discovery_systems")),
        "signal_tier": signal_tier(F.concat_ws(" ", F.coalesce("title", empty), F.coalesce("abstract_or_snippet", empty))), "metadata_stratum": F.when(text != "", "TITLE_ABSTRACT").otherwise("TITLE_ONLY"),
        "full_text_bin": F.when(F.col("full_text_status") == "NOT_IDENTIFIED", "NOT_IDENTIFIED").otherwise("IDENTIFIED"), "document_type_stratum": F.substring(F.upper(X.strip(kind)), 1, 60),
    })


def _pool(rows: DataFrame, seed: str, key: str, size: int) -> DataFrame:
    """The few rows that any pass can take: of every level and bucket the first in its order, as many as the whole sample can hold back and the quota asks.

    No pass sees more than ``size`` rows taken, so ``size`` and its quota more of a
    level are enough; their number depends on the levels only.
    """
    wanted = []
    for field, minimum in PASSES:
        order = sampling.stable_hash(seed, F.concat(F.lit(f"ensure|{field}|"), F.col(field)), F.col(key))
        wanted.append(rows.select(key, F.row_number().over(Window.partitionBy(field).orderBy(order)).alias("n")).where(F.col("n") <= size + minimum).select(key))
    bucket = F.concat_ws("|", *BUCKET)
    order = sampling.stable_hash(seed, F.concat(F.lit("bucket|"), bucket), F.col(key))
    wanted.append(rows.select(key, F.row_number().over(Window.partitionBy(*BUCKET).orderBy(order)).alias("n")).where(F.col("n") <= 2 * size).select(key))
    return rows.join(reduce(DataFrame.unionByName, wanted).distinct(), key, "left_semi")


def select(rows: DataFrame, seed: str, key: str = "corpus_id", size: int = SIZE, validation: int = VALIDATION) -> DataFrame:
    """The sample of prepared ``rows``: six quota passes in turn, then one row of every bucket in turn up to ``size``.

    With calibration_record_id in stable order and split. The passes run over a pool of
    bounded size; each sees what those before it took.
    """
    common = sampling.top_levels(rows.select(F.col("document_type_stratum").alias("level")), "level", COMMON_TYPES).select(F.col("level").alias("document_type_stratum"))
    # The order of every pass is settled by the pool, so the passes themselves are small.
    kept = _pool(rows, seed, key, size).select(key, *dict.fromkeys([f for f, _ in PASSES])).withColumn("taken", F.lit(False))
    from tidewrack.session import Scratch

    scratch = Scratch(rows.sparkSession, "sample")
    now = scratch.keep(kept)
    for field, minimum in PASSES:
        levels = list(FAMILY_ORDER) if field == "primary_family" else common if field == "document_type_stratum" else None
        now = scratch.keep(sampling.ensure_levels(now, field, minimum, seed, key, levels=levels))
    taken = scratch.keep(sampling.round_robin(now, BUCKET, size, seed, key).where("taken").select(key))
    numbered = sampling.numbered(taken, sampling.stable_hash(seed, "final-sample", F.col(key)), "calibration_record_id")
    out = rows.join(F.broadcast(sampling.locked_split(numbered, validation, seed, key)), key)  # ``size`` rows
    out._scratch = scratch
    return out


def human_labels(sample: DataFrame) -> DataFrame:
    """The sample with empty columns for a person's judgement."""
    return sample.withColumns({c: F.lit("") for c in HUMAN})


def blinded(rows: DataFrame, known: DataFrame, seed: str, key: str = "corpus_id") -> tuple[DataFrame, DataFrame]:
    """(blinded set, key table) of the known items in prepared ``rows``, numbered in stable order.

    ``known`` has ``key``, benchmark_id and expected_screening, few rows; of several
    for one key the greatest benchmark_id counts. The blinded set has neither.
    """
    one = known.groupBy(key).agg(F.max(F.struct("benchmark_id", "expected_screening")).alias("k")).select(key, "k.*")
    found = rows.select(key).distinct().join(F.broadcast(one) if one.limit(10_001).count() <= 10_000 else one, key)
    order = F.sha2(F.concat_ws("|", F.lit(f"{seed}|benchmark"), F.col(key)), 256)
    named = sampling.numbered(found, order, "calibration_record_id", "BV-%03d")
    shown = human_labels(rows.join(named.select(key, "calibration_record_id"), key).withColumn("split", F.lit("BENCHMARK_VALIDATION")))
    return shown, named.select("calibration_record_id", key, "benchmark_id", "expected_screening")


def strata_counts(sample: DataFrame) -> DataFrame:
    """(field, level, rows) of the sample."""
    fields = [*dict.fromkeys([f for f, _ in PASSES]), "split"]
    long = sample.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("level")) for f in fields])).alias("l")).select("l.*")
    return long.groupBy("field", "level").agg(F.count("*").alias("rows"))


def calibration_qa(sample: DataFrame, shown: DataFrame, known: DataFrame, size: int = SIZE, validation: int = VALIDATION, key: str = "corpus_id") -> DataFrame:
    """One row of counts and checks."""
    s = sample.agg(F.count("*").alias("sample_rows"), F.count_if(F.col("split") == "VALIDATION").alias("validation_rows"), F.countDistinct(key).alias("ids"))
    b = shown.agg(F.count("*").alias("benchmark_validation_rows"), F.coalesce(F.bool_and(F.col("human_decision") == ""), F.lit(True)).alias("human_labels_blank"))
    both = sample.join(known.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("both"))
    one = s.crossJoin(b).crossJoin(both)  # three rows of one
    return one.select("sample_rows", (F.col("sample_rows") - F.col("validation_rows")).alias("development_rows"), "validation_rows", "benchmark_validation_rows", (F.col("sample_rows") == size).alias("sample_size_met"), (F.col("validation_rows") == validation).alias("validation_size_met"), (F.col("ids") == F.col("sample_rows")).alias("sample_corpus_ids_unique"), (F.col("both") == 0).alias("benchmarks_excluded_from_calibration"), "human_labels_blank")


def row_gate(df: DataFrame, expected: int, what: str) -> DataFrame:
    """``df``, or an error where it does not have the expected number of rows."""
    found = df.count()
    if found != expected:
        raise ValueError(f"expected {expected} {what} rows, found {found}")
    return df
