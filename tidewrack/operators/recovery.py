"""Recovery of known items in a corpus: scored exact matches, status, the nearest similar title, and target flags."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions import text as X
from tidewrack.functions.unicode import let
from tidewrack.session import spread

# What each kind of exact evidence scores.
SCORES = {"DOI": 100, "CANONICAL_URL": 95, "EXACT_TITLE": 90, "RESOLVED_ALIAS_DOI": 85, "RESOLVED_ALIAS_TITLE": 80}
#: Known titles that one pass over the corpus is compared with; more go in blocks, one pass each.
KNOWN_BLOCK = 10_000


def exact_evidence(known: DataFrame, corpus: DataFrame) -> DataFrame:
    """(known_id, corpus_id, score, basis): the best score and all bases, by one equi-join on (field, value).

    ``known`` has known_id and any of doi, url, norm_title, alias_doi, alias_title;
    ``corpus`` corpus_id, doi, url, norm_title; ``url`` may be an array. Empty values match nothing.
    """
    kinds = [("DOI", "doi", "doi"), ("CANONICAL_URL", "url", "url"), ("EXACT_TITLE", "norm_title", "norm_title"), ("RESOLVED_ALIAS_DOI", "alias_doi", "doi"), ("RESOLVED_ALIAS_TITLE", "alias_title", "norm_title")]
    values = lambda df, c: F.col(c) if dict(df.dtypes)[c].startswith("array") else F.array(c)

    def evidence(basis: str, column: str, field: str) -> Column:
        return F.transform(values(known, column), lambda v: F.struct(F.lit(basis).alias("basis"), F.lit(SCORES[basis]).alias("score"), F.lit(field).alias("field"), v.alias("value")))

    def held_in(field: str) -> Column:
        return F.transform(values(corpus, field), lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    side = F.flatten(F.array(*[evidence(k, a, c) for k, a, c in kinds if a in known.columns]))
    asked = known.select("known_id", F.explode(side).alias("e")).select("known_id", "e.*").where("value <> ''")
    own = F.flatten(F.array(*[held_in(c) for c in ("doi", "url", "norm_title")]))
    held = corpus.select("corpus_id", F.explode(own).alias("h")).select("corpus_id", "h.*").where("value <> ''")
    return held.join(asked, ["field", "value"]).groupBy("known_id", "corpus_id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("basis")), " | ").alias("basis"))


def best_match(evidence: DataFrame) -> DataFrame:
    """The match with the highest score, then the smallest id."""
    return evidence.groupBy("known_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "corpus_id", "basis")).alias("m")).select("known_id", F.col("m.corpus_id").alias("corpus_id"), (-F.col("m.s")).alias("score"), F.col("m.basis").alias("basis"))


def recovery_status(known: DataFrame, corpus: DataFrame, remedial: Mapping[str, set[str]] | None = None) -> DataFrame:
    """Every known item with its best match: known_id, recovery_status, match_basis, matched_corpus_id, independently_recovered.

    ``remedial`` names for a known item the queries that were made to find it; a match
    that no other query found is RECOVERED_AFTER_REMEDIATION. The corpus has query_ids,
    joined by pipes.
    """
    best = best_match(exact_evidence(known, corpus)).join(corpus.select("corpus_id", "query_ids"), "corpus_id")
    queries = X.split_pipe(F.col("query_ids"))
    made = F.lit(False)
    for item, names in (remedial or {}).items():
        made = made | ((F.col("known_id") == item) & (F.size(queries) > 0) & (F.size(F.array_except(queries, F.array(*map(F.lit, sorted(names))))) == 0))
    out = known.select("known_id").distinct().join(best, "known_id", "left")
    status = F.when(F.col("corpus_id").isNull(), "NOT_RECOVERED").when(made, "RECOVERED_AFTER_REMEDIATION").otherwise("RECOVERED")
    return out.select("known_id", status.alias("recovery_status"), F.coalesce("basis", F.lit("NO_EXACT_MATCH")).alias("match_basis"), F.coalesce("corpus_id", F.lit("")).alias("matched_corpus_id"), (F.col("corpus_id").isNotNull() & ~made & (F.size(queries) > 0)).alias("independently_recovered"))


def recovery_counts(status: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per type of known item (``kinds``: known_id, kind): total, recovered, after remediation, accounted for."""
    s = F.col("recovery_status")
    return status.join(kinds, "known_id").groupBy("kind").agg(F.count("*").alias("total"), F.count_if(s == "RECOVERED").alias("initially_recovered"), F.count_if(s == "RECOVERED_AFTER_REMEDIATION").alias("recovered_after_remediation"), F.count_if(s != "NOT_RECOVERED").alias("accounted"))


def diagnostics(status: DataFrame, nearest: DataFrame, kinds: DataFrame, core: str) -> DataFrame:
    """Known items that were not recovered, with the nearest title and what to do, by whether they are of the ``core`` kind."""
    # The words of the report.
    action = F.when(F.col("kind") == core, "Review closest candidate; design a justified _02 search only if the benchmark is truly absent").otherwise("No query revision required; retain result for the later screening-specificity check")
    missed = status.where("recovery_status = 'NOT_RECOVERED'").select("known_id").join(kinds, "known_id").join(nearest, "known_id", "left")
    return missed.select("known_id", "kind", F.lit("No exact DOI, canonical URL, resolved alias, or normalized-title match").alias("diagnosis"), F.coalesce("corpus_id", F.lit("")).alias("closest_corpus_id"), F.format_string("%.4f", F.coalesce("similarity", F.lit(0.0))).alias("closest_title_similarity"), action.alias("recommended_action"))


def nearest_words(known: DataFrame, corpus: DataFrame) -> DataFrame:
    """(known_id, corpus_id, similarity): the corpus title with the largest share of common words; none in common, no row."""
    words = lambda df, i: df.select(i, "norm_title", F.explode(F.array_distinct(F.split("norm_title", " "))).alias("word"))
    asked = words(known, "known_id").withColumnRenamed("norm_title", "asked")
    met = words(corpus, "corpus_id").join(F.broadcast(asked) if known.limit(10_001).count() <= 10_000 else asked, "word").select("known_id", "asked", "corpus_id", "norm_title").distinct()
    return met.withColumn("similarity", X.token_jaccard(F.col("asked"), F.col("norm_title"))).where("similarity > 0").groupBy("known_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "corpus_id")).alias("m")).select("known_id", F.col("m.corpus_id").alias("corpus_id"), (-F.col("m.s")).alias("similarity"))


def _letters(titles: list[str]) -> np.ndarray:
    """How often every letter of a fixed alphabet, and any other one, stands in each title."""
    out = np.zeros((len(titles), 38), dtype=np.int16)
    for i, t in enumerate(titles):
        for c in t:
            k = ord(c)
            out[i, k - 96 if 97 <= k <= 122 else k - 21 if 48 <= k <= 57 else 0 if c == " " else 37] += 1
    return out


def nearest_title(known: DataFrame, corpus: DataFrame) -> DataFrame:
    """(known_id, corpus_id, similarity): the corpus title with the greatest sequence ratio, then the smallest id; no ratio, no row.

    The known items are the stated query set: every batch of distinct corpus titles is
    compared with all of them, the nearest by letters in common first. That count is
    an upper bound of the ratio, so what cannot beat the best so far is skipped and
    nothing is lost. Titles are ``norm_title``; empty ones match nothing.
    """
    from difflib import SequenceMatcher

    spark = known.sparkSession
    asked = known.where("norm_title <> ''").select("known_id", "norm_title").distinct()
    blocks = -(-asked.count() // KNOWN_BLOCK) or 1
    titles = corpus.where("norm_title <> ''").groupBy("norm_title").agg(F.min("corpus_id").alias("corpus_id"))
    kinds = dict(known.dtypes)["known_id"], dict(corpus.dtypes)["corpus_id"]
    schema = f"known_id {kinds[0]}, corpus_id {kinds[1]}, similarity double"
    found = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("known_id"), F.lit(blocks)) == k).collect()  # some KNOWN_BLOCK rows
        shipped = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def compare(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            items = shipped.value
            counts, sizes = _letters([t for _, t in items]), np.array([len(t) for _, t in items])
            for batch in batches:
                own, lengths = _letters(batch["norm_title"].tolist()), batch["norm_title"].str.len().to_numpy()
                out = []
                for i, (item, title) in enumerate(items):
                    bound = 2.0 * np.minimum(own, counts[i]).sum(axis=1) / (lengths + sizes[i])
                    best: tuple[float, object] | None = None
                    for j in np.argsort(-bound, kind="stable"):
                        if best is not None and bound[j] < -best[0] or bound[j] == 0:
                            break
                        ratio = SequenceMatcher(None, title, batch["norm_title"].iat[j]).ratio()
                        if ratio and (best is None or (-ratio, batch["corpus_id"].iat[j]) < best):
                            best = (-ratio, batch["corpus_id"].iat[j])
                    if best is not None:
                        out.append((item, best[1], -best[0]))
                yield pd.DataFrame(out, columns=["known_id", "corpus_id", "similarity"])

        part = spread(titles.select("norm_title", "corpus_id")).mapInPandas(compare, schema)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("known_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "corpus_id")).alias("m")).select("known_id", F.col("m.corpus_id").alias("corpus_id"), (-F.col("m.s")).alias("similarity"))


def target_flags(results: DataFrame, targets: DataFrame, order: list[Column]) -> DataFrame:
    """``results`` (query_id, title, url, content) of queries with a target, ranked, with exact_target_title, exact_target_url and first_match.

    ``targets`` has query_id, title and url. ``first_match`` is the query's first
    result that is its target; the content is cut to twenty words.
    """
    aim = targets.select("query_id", X.normalize_text(F.col("title")).alias("t"), X.bare_url(F.col("url")).alias("u"))
    ranked_ = ranked(results, "query_id", order).join(aim, "query_id")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    flagged = ranked_.withColumns({"exact_target_title": same(X.normalize_text(F.col("title")), F.col("t")), "exact_target_url": same(X.bare_url(F.col("url")), F.col("u")), "content": X.first_words(F.col("content"))}).drop("t", "u")
    hit = F.col("exact_target_title") | F.col("exact_target_url")
    first = flagged.where(hit).groupBy("query_id").agg(F.min("result_rank").alias("first"))
    return flagged.join(first, "query_id", "left").withColumn("first_match", F.coalesce(F.col("result_rank") == F.col("first"), F.lit(False))).drop("first")


def best_line(pages: DataFrame, target: str, host: str = "") -> DataFrame:
    """(page_id, line, similarity, validated): the line of each page most like ``target``, the first of equals.

    ``pages`` has page_id, content and url. Lines lose their mark-up; they are
    validated if they hold the whole target and the page's host ends in ``host``.
    """
    lines = pages.select("page_id", "url", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")).alias("at", "line")).where(F.trim("line") != "")
    lines = lines.select("page_id", "url", "at", F.trim(F.regexp_replace("line", r"[#*_`>\[\]()]", " ")).alias("line"))
    aim = X.normalize_text(F.lit(target))
    scored = lines.withColumn("similarity", X.sequence_ratio(aim, X.normalize_text(F.col("line"))))
    best = scored.groupBy("page_id").agg(F.max(F.struct("similarity", F.negative("at").alias("n"), "line", "url")).alias("b"))
    at_host = F.lower(F.regexp_extract(F.col("b.url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).endswith(host.lower()) if host else F.lit(True)
    return best.select("page_id", "b.line", F.round("b.similarity", 4).alias("similarity"), let(X.normalize_text(F.col("b.line")), lambda v: v.contains(aim) & F.coalesce(at_host, F.lit(False))).alias("validated"))


def ranked(df: DataFrame, by: str, order: list[Column], out: str = "result_rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
