"""Citation chaining: seeds from a corpus, families handed down along edges, and the tables of edges and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import text as X
from tidewrack.functions.unicode import let
from tidewrack.operators import graph
from tidewrack.session import Scratch

# What a seed rests on, and the parent of an edge that no seed explains.
SEED_BASIS = "title organism+stressor; >=2 systems or >=3 occurrences"
NO_PARENT = "CHAIN_GENERATION_1"


def resolve_doi(wanted: DataFrame, works: DataFrame) -> DataFrame:
    """(key, work_id): works by DOI, the smallest id of each; ``wanted`` has key and doi."""
    known = works.select("work_id", X.strip_doi(F.col("doi")).alias("d")).where("d <> ''").groupBy("d").agg(F.min("work_id").alias("work_id"))
    return wanted.select("key", X.strip_doi(F.col("doi")).alias("d")).where("d <> ''").join(known, "d").select("key", "work_id")


def primary_seeds(corpus: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, unresolved): promising, strongly found corpus rows under every work id they hold, else under their DOI's.

    ``corpus`` has corpus_id, title, doi, families, discovery_systems, occurrence_count
    and source_record_ids (pipe lists). ``unresolved`` has the corpus_id of those without a work.
    """
    systems = F.size(F.filter(F.split("discovery_systems", r" \| "), lambda s: s != ""))
    strong = corpus.where(((systems >= 2) | (F.col("occurrence_count") >= 3)) & graph.promising(F.col("title"))).withColumn("ids", X.work_ids(F.col("source_record_ids")))
    named = strong.where(F.size("ids") > 0).select("corpus_id", F.explode("ids").alias("work_id"))
    bare = strong.where((F.size("ids") == 0) & (F.col("doi") != "")).select(F.col("corpus_id").alias("key"), "doi")
    by_doi = resolve_doi(bare, works).select(F.col("key").alias("corpus_id"), "work_id")
    held = named.join(works.select("work_id").distinct(), "work_id", "left_semi").unionByName(by_doi).distinct()
    columns = ("corpus_id", "title", "doi", "families", "discovery_systems", "occurrence_count")
    seeds = strong.select(*columns).join(held, "corpus_id").select(F.lit(0).alias("seed_generation"), *columns, "work_id", F.lit(SEED_BASIS).alias("seed_basis"))
    return seeds, strong.join(held.select("corpus_id").distinct(), "corpus_id", "left_anti").select("corpus_id")


def origins(seeds: DataFrame, edges: DataFrame, second: DataFrame) -> DataFrame:
    """(parent, corpus_ids, families): what every seed hands down; a seed of the second generation inherits its parents' families."""
    first = seeds.groupBy(F.col("work_id").alias("parent")).agg(F.collect_set("corpus_id").alias("corpus_ids"), F.array_distinct(F.flatten(F.collect_set(F.split("families", r" \| ")))).alias("families"))
    handed = edges.where("generation = 1").join(second.select(F.col("work_id").alias("child")).distinct(), "child", "left_semi").select("child", "parent").distinct()
    inherited = handed.join(first.select("parent", "families"), "parent", "left").groupBy("child").agg(F.array_distinct(F.flatten(F.collect_set(F.coalesce("families", F.array().cast("array<string>"))))).alias("families"))
    later = second.select(F.col("work_id").alias("child")).distinct().join(inherited, "child", "left").select(F.col("child").alias("parent"), F.array(F.concat(F.lit(f"{NO_PARENT}:"), "child")).alias("corpus_ids"), F.coalesce("families", F.array().cast("array<string>")).alias("families"))
    both = first.unionByName(later)
    return both.groupBy("parent").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("corpus_ids")))).alias("corpus_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"))  # two rows a parent at most


def edge_table(edges: DataFrame, handed: DataFrame) -> DataFrame:
    """Edges with the corpus ids and families of their parents; a parent no seed explains has a default and no family."""
    known = edges.join(handed, "parent", "left")
    return known.select("generation", "route", F.col("parent").alias("parent_work_id"), F.coalesce("corpus_ids", F.array(F.lit(NO_PARENT))).alias("corpus_ids"), F.col("child").alias("discovered_work_id"), F.coalesce("families", F.array().cast("array<string>")).alias("families"))


def joined(values: Column) -> Column:
    return F.array_join(F.array_sort(values), " | ")


def candidates(table: DataFrame, works: DataFrame, existing_ids: DataFrame, existing_dois: DataFrame) -> DataFrame:
    """One row per discovered work: evidence as sorted sets, metadata, and whether the corpus has it by id or by DOI.

    ``works`` has work_id, doi, title, year, publication_date, work_type, language, authors,
    source, landing_page_url, pdf_url, is_oa, cited_by_count and abstract;
    ``existing_ids`` is (work_id), ``existing_dois`` (doi).
    """
    sets = table.groupBy(F.col("discovered_work_id").alias("work_id")).agg(
        joined(F.collect_set(F.concat(F.lit("OA_CHAIN_G"), "generation", F.lit("_"), "route"))).alias("query_ids"), joined(F.array_distinct(F.flatten(F.collect_set("families")))).alias("families"),
        joined(F.collect_set(F.col("generation").cast("string"))).alias("generations"), joined(F.collect_set("route")).alias("routes"), F.collect_set("parent_work_id").alias("parents"), joined(F.array_distinct(F.flatten(F.collect_set("corpus_ids")))).alias("parent_corpus_ids"),
    )
    pdf, open_ = X.clean(F.col("pdf_url")), F.coalesce("is_oa", F.lit(False))
    landing = F.coalesce(F.nullif(X.clean(F.col("landing_page_url")), F.lit("")), F.nullif(X.clean(F.col("doi")), F.lit("")), F.col("work_id"))
    told = works.select(
        "work_id", X.strip_doi(F.col("doi")).alias("doi"), X.clean(F.col("title")).alias("title"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("publication_year"), X.clean(F.col("publication_date")).alias("publication_date"), X.clean(F.col("work_type")).alias("work_type"),
        X.clean(F.col("language")).alias("language"), F.coalesce("authors", F.lit("")).alias("authors"), X.clean(F.col("source")).alias("primary_source"), landing.alias("landing_page_url"), full_text(pdf != "", open_).alias("full_text_status"),
        F.when(pdf != "", pdf).when(open_, landing).otherwise("").alias("full_text_location"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), F.coalesce("abstract", F.lit("")).alias("abstract"),
    )
    by_id = existing_ids.select("work_id", F.lit(True).alias("by_id")).distinct()
    by_doi = existing_dois.where("doi <> ''").select("doi", F.lit(True).alias("by_doi")).distinct()
    found = sets.join(told, "work_id").join(by_id, "work_id", "left").join(by_doi, "doi", "left")
    return found.withColumn("already_in_candidate_corpus", F.coalesce("by_id", "by_doi", F.lit(False))).withColumn("parent_work_ids", joined(F.col("parents"))).withColumn("parent_count", F.size("parents")).drop("by_id", "by_doi", "parents")


def full_text(pdf: Column, open_: Column) -> Column:
    """Full-text status of a chained work: a document, a landing page of an open one, or nothing."""
    return F.when(pdf, "OPEN_ACCESS_PDF").when(open_, "OPEN_ACCESS_LANDING_PAGE").otherwise("NOT_IDENTIFIED")


def chain(corpus: DataFrame, works: DataFrame) -> dict[str, DataFrame]:
    """The whole of two generations: seeds, unresolved, second (seeds), edges and candidates.

    ``works`` also has referenced_works and related_works (arrays of work ids).
    """
    scratch = Scratch(works.sparkSession, "chain")
    # Each of these is read several times below; the graph goes without the works' texts.
    corpus = scratch.keep(corpus)
    links = scratch.keep(works.select("work_id", "doi", "referenced_works", "related_works", graph.promising(F.col("title")).alias("promising")))
    seeds, unresolved = primary_seeds(corpus, links)
    seeds = scratch.keep(seeds)
    existing = scratch.keep(corpus.select(F.explode(X.work_ids(F.col("source_record_ids"))).alias("work_id")).distinct())
    first = scratch.keep(graph.metadata_edges(links, seeds.select("work_id"), 1))
    second = scratch.keep(graph.next_seeds(first, links, existing, F.col("promising")))
    edges = scratch.keep(first.unionByName(graph.metadata_edges(links, second, 2)))
    table = scratch.keep(edge_table(edges, origins(seeds, edges, second)))
    dois = corpus.select(let(X.strip_doi(F.col("doi")), lambda d: d).alias("doi"))
    parts = {"seeds": seeds, "unresolved": unresolved, "second": second, "edges": table, "candidates": candidates(table, works, existing, dois)}
    for part in parts.values():
        part._scratch = scratch
    return parts


def chain_counts(table: DataFrame) -> DataFrame:
    """Edges per route and generation."""
    return table.groupBy("route", "generation").agg(F.count("*").alias("edges"), F.countDistinct("discovered_work_id").alias("works"))


def chain_qa(parts: dict[str, DataFrame], most: int = 2) -> DataFrame:
    """One row of counts and checks of a chain."""
    edges = parts["edges"].agg(F.count("*").alias("citation_edges"), F.coalesce(F.bool_and(F.col("generation") <= most), F.lit(True)).alias("generation_cap_respected"), F.coalesce(F.bool_and((F.col("parent_work_id") != "") & (F.col("discovered_work_id") != "")), F.lit(True)).alias("all_edges_have_parent_and_child"), F.countDistinct("discovered_work_id").alias("discovered"))
    seeds = parts["seeds"].agg(F.count("*").alias("primary_seed_rows"), F.countDistinct("work_id").alias("primary_seed_works"))
    found = parts["candidates"].agg(F.count("*").alias("unique_discovered_works"), F.count_if("already_in_candidate_corpus").alias("already_present_before_merge"))
    second = parts["second"].agg(F.countDistinct("work_id").alias("generation_2_seed_works"))
    lost = parts["unresolved"].agg(F.count("*").alias("unresolved_seed_candidates"))
    one = edges.crossJoin(seeds).crossJoin(found).crossJoin(second).crossJoin(lost)  # five rows of one
    return one.withColumn("all_discovered_ids_have_metadata", F.col("discovered") == F.col("unique_discovered_works")).withColumn("new_to_candidate_corpus_before_merge", F.col("unique_discovered_works") - F.col("already_present_before_merge")).drop("discovered")
