"""Queries of the discovery pipeline's operators over the driver's tables, each with its SQL.

SQL stands beside each query; where SQL cannot say what the operator does, there is
none, and the tests compare it with brute force.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.functions import text as X
from tidewrack.operators import calibration, export, graph, resolution, sampling, search
from tidewrack.sources import files
from tidewrack.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED = "tidewrack-calibration-1"


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query, with its SQL if there is any."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


# Parts of SQL that several queries share.
_CLEAN = r"trim(regexp_replace(coalesce({0},''),'[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{1680}}\x{{2028}}\x{{2029}}\x{{0085}}\x{{001c}}-\x{{001f}}]+',' ','g'))"
_YEAR = r"regexp_extract({0},'\b((?:18|19|20)\d{{2}})\b',1)"
_DOI = r"regexp_replace(regexp_extract(lower(trim(replace(replace(replace(replace(coalesce({0},''),'%2F','/'),'%2f','/'),'%28','('),'%29',')'))),'10\.\d{{4,9}}/[-._;()/:a-z0-9]+'),'[.,;:)\]}}\"]+$','')"


_KEY = "trim(regexp_replace(lower(coalesce(title,'')),'[^a-z0-9]+',' ','g'))"


def _sql(template: str, column: str) -> str:
    return template.format(column)


@query(rf"select occurrence_id, {_sql(_CLEAN, 'source_title')} as cleaned, substring({_sql(_CLEAN, 'source_title')},1,20) as excerpt from records")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "records", "occurrence_id", "source_title").select("occurrence_id", X.clean_space(F.col("source_title")).alias("cleaned"), X.excerpt(F.col("source_title"), 20).alias("excerpt"))


@functools.cache
def _ascii_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What is left of every character beyond ASCII by compatibility decomposition: one to one, and the few that give several."""
    source, target, several = [], [], []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1 and plain != "'":
            source.append(chr(code))
            target.append(plain)
        elif plain:
            several.append((chr(code), plain.replace("'", "''")))
    return "".join(source), "".join(target), tuple(several)


def _ascii_sql(column: str) -> str:
    """The ASCII part of a text's compatibility decomposition; characters that give several letters only as far as any title may show them."""
    source, target, several = _ascii_tables()
    out = f"translate({column},'{source}','{target}')"
    # Ligatures, fractions, Roman numerals and other letter-like characters; squared and circled ones are in no title's script.
    for char, plain in several:
        if unicodedata.category(char) in ("Ll", "Lu", "Lo", "Nl", "Po", "Pd", "Ps", "Pe") and len(plain) <= 4:
            out = f"replace({out},'{char}','{plain}')"
    return f"regexp_replace({out},'[^\\x00-\\x7f]+','','g')"


_NORM = f"trim(regexp_replace(replace(lower({_ascii_sql(_sql(_CLEAN, 'title'))}),'&',' and '),'[^a-z0-9]+',' ','g'))"


@query(f"select occurrence_id, regexp_replace(n,'^(?:the|a|an) +','') as with_article_cut, n as with_article, {_KEY} as plain_text from (select occurrence_id, title, {_NORM} n from records)")
def normalize_title(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title")
    return table(spark, sf, "records", "occurrence_id", "title").select("occurrence_id", X.normalize_title(t).alias("with_article_cut"), X.normalize_title(t, article=False).alias("with_article"), X.normalize_text(t).alias("plain_text"))


@query(rf"select occurrence_id, {_sql(_DOI, 'doi')} as doi, case when coalesce(year,'')<>'' then {_sql(_YEAR, 'year')} else {_sql(_YEAR, chr(39) * 2 + '||coalesce(publication_date,' + chr(39) * 2 + ')')} end as year from records")
def extract_year_doi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "records", "occurrence_id", "doi", "year", "publication_date").select("occurrence_id", X.normalize_doi(F.col("doi")).alias("doi"), X.normalize_year(F.col("year"), F.col("publication_date")).alias("year"))


@query()
def canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "records", "occurrence_id", "url").select("occurrence_id", X.normalize_url(u).alias("corpus_form"), X.recovery_url(u).alias("recovery_form"), X.bare_url(u).alias("bare_form"), X.strip_doi(u).alias("doi_form"))


_DOMAIN = r"regexp_replace(lower(regexp_extract(coalesce(url,''),'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)',1)),'^www\.','')"


@query(f"select {_DOMAIN} as domain, count(*) as results from records where {_DOMAIN}<>'' group by 1")
def url_domain_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "records", "url").select(X.url_domain(F.col("url")).alias("domain")).where("domain <> ''").groupBy("domain").agg(F.count("*").alias("results"))




@query(f"""
with k as (select occurrence_id, coalesce(title,'') t, coalesce(abstract_or_snippet,'') a, coalesce(year,'') y, {_KEY} k, row_number() over (order by occurrence_id) i from records),
c as (select *, case when length(k)>=15 then k else 'one:'||occurrence_id end g from k),
n as (select *, first_value(y) over (partition by g order by i) ay from c),
m as (select *, case when ay='' or y='' or abs(try_cast(ay as int)-try_cast(y as int))<=1 then g else 'one:'||occurrence_id end cl from n)
select min(occurrence_id) as cluster_id, count(*) as occurrences, arg_max(t, (length(t), -i)) as title, max(length(a)) as longest_abstract from m group by cl""")
def exact_title_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Exact titles whose year agrees with the first record's, with survivorship."""
    one = F.concat(F.lit("one:"), "occurrence_id")
    k = table(spark, sf, "records", "occurrence_id", "title", "abstract_or_snippet", "year").select("occurrence_id", F.coalesce("title", F.lit("")).alias("t"), F.length(F.coalesce("abstract_or_snippet", F.lit(""))).alias("a"), F.coalesce("year", F.lit("")).alias("y"), X.normalize_text(F.col("title")).alias("k"))
    g = k.withColumn("g", F.when(F.length("k") >= 15, F.col("k")).otherwise(one))
    first = g.groupBy("g").agg(F.min_by("y", "occurrence_id").alias("ay"))
    m = g.join(first, "g").withColumn("cl", F.when(X.compatible_year(F.col("ay"), F.col("y")), F.col("g")).otherwise(one))
    low = F.min(F.struct((-F.length("t")).alias("n"), "occurrence_id", "t"))
    return m.groupBy("cl").agg(F.min("occurrence_id").alias("cluster_id"), F.count("*").alias("occurrences"), low.alias("b"), F.max("a").alias("longest_abstract")).select("cluster_id", "occurrences", F.col("b.t").alias("title"), "longest_abstract")


OCCURRENCE = ("occurrence_id", "system", "query_id", "family", "source_file", "source_record_id", "title", "authors", "year", "publication_date", "source_title", "document_type", "doi", "url", "language", "abstract_or_snippet", "retrieved_date", "full_text_status", "full_text_location", "extra_identifiers")


def _occurrences(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "records", *OCCURRENCE)
    return resolution.finalize(rows.withColumn("occ_idx", F.regexp_extract("occurrence_id", r"(\d+)", 1).cast("long")))


def _resolved(spark: SparkSession, sf: str) -> resolution.Resolution:
    return resolution.Resolution(_occurrences(spark, sf))


@query()
def resolved_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus: one row per cluster of the four passes, with id, survivors and basis."""
    return _resolved(spark, sf).corpus()


@query()
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence under the corpus id of its cluster, with its own basis; ordered by (least, occ_idx) on output."""
    found = _resolved(spark, sf).provenance()
    own = {"system": "discovery_system", **{c: f"original_{c}" for c in ("title", "authors", "year", "doi", "url")}}
    names = ("occurrence_id", "system", "query_id", "family", "source_file", "source_record_id", "title", "authors", "year", "doi", "url", "retrieved_date", "full_text_status", "full_text_location", "extra_identifiers")
    out = found.select("corpus_id", *[F.col(c).alias(own.get(c, c)) for c in names], "deduplication_basis", "least", "occ_idx")
    out._resolution = found
    return out


@query()
def identifier_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Every refusal of all passes."""
    return _resolved(spark, sf).conflicts()


@query()
def fuzzy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed pairs of similar titles, between the representatives of the clusters as they stand when compared."""
    found = _resolved(spark, sf)
    out = found.reviews().select("l_occ_idx", "r_occ_idx", F.round("jaccard", 4).alias("jaccard"), F.round("ratio", 4).alias("ratio"), "decision", "rationale")
    out._resolution = found
    return out


@query()
def corpus_qa(spark: SparkSession, sf: str) -> DataFrame:
    """One row of counts and checks of the resolved corpus, as JSON."""
    found = _resolved(spark, sf)
    corpus, rows = found.corpus(), found.rows
    filled = lambda c: F.count_if(F.col(c) != "")
    c = corpus.agg(
        F.count("*").alias("unique_candidate_records"), (F.count("*") - filled("title")).alias("missing_title_records"), (F.count("*") - filled("year")).alias("missing_year_records"), (F.count("*") - filled("doi")).alias("missing_doi_records"),
        F.sum("occurrence_count").alias("occurrences"), (F.countDistinct("corpus_id") == F.count("*")).alias("corpus_ids_unique"), (F.countDistinct(F.nullif("doi", F.lit(""))) == filled("doi")).alias("doi_values_unique_across_corpus"),
        F.coalesce(F.bool_and((F.col("full_text_status") == "NOT_IDENTIFIED") | (F.col("full_text_locations") != "")), F.lit(True)).alias("full_text_locations_present_when_identified"),
    )
    r = rows.agg(F.count("*").alias("input_occurrences_total"), F.max(F.nullif(F.col("retrieved_date"), F.lit(""))).alias("generated_date"), (F.countDistinct("occurrence_id") == F.count("*")).alias("occurrence_ids_unique"), F.coalesce(F.bool_and(X.clean_space(F.col("query_id")) != ""), F.lit(True)).alias("no_empty_query_ids"))
    v = found.reviews().agg(F.count("*").alias("fuzzy_pairs_reviewed"), F.count_if(F.col("decision") == "MERGE").alias("fuzzy_pairs_merged"))
    k = found.conflicts().agg(F.count("*").alias("identifier_conflicts_kept_separate"))
    one = c.crossJoin(r).crossJoin(v).crossJoin(k)  # four rows of one
    one = one.withColumn("duplicate_occurrences_collapsed", F.col("input_occurrences_total") - F.col("unique_candidate_records")).withColumn("occurrence_counts_reconcile", F.col("occurrences") == F.col("input_occurrences_total"))
    out = export.qa_json(one.drop("occurrences"))
    out._resolution = found
    return out


_EXACT = f"""
with r as (select cast(regexp_extract(occurrence_id,'(\\d+)',1) as bigint) i, occurrence_id, {_sql(_DOI, 'doi')} doi, coalesce(year,'') y, {_KEY} k, coalesce(title,'') t from records),
d as (select *, case when doi<>'' then min(i) over (partition by doi) end df from r),
l as (select *, first_value(y) over w ay, first_value(i) over w ai, first_value(doi) over w ad, first_value(t) over w att, count(*) over (partition by k) n from d where length(k)>=15 window w as (partition by k order by i rows between unbounded preceding and unbounded following)),
m as (select * from l where n>1 and (ay='' or y='' or abs(try_cast(ay as int)-try_cast(y as int))<=1)),
f as (select *, arg_min(doi,i) filter (doi<>'') over (partition by k) bd, arg_min(df,i) filter (doi<>'') over (partition by k) bf, count(*) over (partition by k) mn from m)"""


def _exact_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "records", "occurrence_id", "title", "doi", "year")
    return rows.select("occurrence_id", F.regexp_extract("occurrence_id", r"(\d+)", 1).cast("long").alias("occ_idx"), X.normalize_doi(F.col("doi")).alias("doi"), F.coalesce("year", F.lit("")).alias("year"), X.normalize_text(F.col("title")).alias("norm_title"), F.coalesce("title", F.lit("")).alias("title"))


@query(f"""{_EXACT}, j as (select i, coalesce(bf, ai) c from f where doi='' and mn>1)
select d.occurrence_id, coalesce(d.df, j.c, d.i) as cluster, case when d.df is not null then 'DOI' when j.c is not null then 'EXACT_TITLE_YEAR' else 'SINGLETON' end as reason from d left join j using (i)""")
def exact_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The DOI and exact-title passes over titles as plain text."""
    rows = _exact_rows(spark, sf)
    return resolution.exact_clusters(rows).join(rows.select("occ_idx", "occurrence_id"), "occ_idx").select("occurrence_id", "cluster", "reason")


@query(f"""{_EXACT} select distinct k as match_key, 'EXACT_TITLE_YEAR' as reason, bd as left_dois, doi as right_dois, att as left_title, t as right_title from f where doi<>'' and doi<>bd""")
def title_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Refusals of the exact-title pass over titles as plain text."""
    return resolution.title_conflicts(_exact_rows(spark, sf))


@query(f"""{_EXACT}, e as (select min(i) over (partition by doi) a, i b, 'DOI' reason from d where doi<>'' union all select ai, i, 'EXACT_TITLE_YEAR' from f where i<>ai and (doi='' or (ad='' and df is not null and i=(select min(g.i) from f g where g.k=f.k and g.doi<>''))))
select reason, count(*) as unions, count(distinct a) as anchors, max(b) as last from e where a<>b group by 1""")
def exact_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The unions of the DOI and exact-title passes, per reason."""
    return resolution.exact_edges(_exact_rows(spark, sf)).groupBy("reason").agg(F.count("*").alias("unions"), F.countDistinct("a").alias("anchors"), F.max("b").alias("last"))


@query("""
with s as (select loaded_at, occurrence_id, upper(trim(regexp_replace(coalesce(system,''),'\\s+',' ','g'))) s from records)
select s as system_label, count(*) as occurrences, min(occurrence_id) as first_id, max(loaded_at) as last_loaded from s group by 1""")
def count_by_system(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "records", "system", "occurrence_id", "loaded_at").groupBy(F.upper(F.trim(F.regexp_replace(F.coalesce("system", F.lit("")), r"\s+", " "))).alias("system_label")).agg(F.count("*").alias("occurrences"), F.min("occurrence_id").alias("first_id"), F.max("loaded_at").alias("last_loaded"))


@query("""
with f as (select occurrence_id, trim(v) v from (select occurrence_id, unnest(string_split(coalesce(family,''),'|')) v from records))
select v as family, count(*) as mentions, count(distinct occurrence_id) as records from f where trim(v)<>'' group by 1""")
def exploded_family_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "records", "occurrence_id", "family").select("occurrence_id", F.explode(X.split_pipe(F.col("family"))).alias("family")).groupBy("family").agg(F.count("*").alias("mentions"), F.countDistinct("occurrence_id").alias("records"))


_TXT = "coalesce(title,'')||' '||coalesce(abstract_or_snippet,'')"
_WHOLE = lambda w: rf"(?i)(?:^|[^\pL\pN_])(?:{w})(?:$|[^\pL\pN_])"
_TIER = f"case when regexp_matches({_TXT},'{_WHOLE(calibration.ORGANISM)}') and regexp_matches({_TXT},'{_WHOLE(calibration.STRESSOR)}') then 'ORGANISM_AND_STRESSOR' when regexp_matches({_TXT},'{_WHOLE(calibration.ORGANISM)}') then 'ORGANISM_ONLY' when regexp_matches({_TXT},'{_WHOLE(calibration.STRESSOR)}') then 'STRESSOR_ONLY' else 'NEITHER_SIGNAL' end"


@query(f"select {_TIER} as tier, count(*) as records from records group by 1")
def signal_tier(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract_or_snippet", F.lit("")))
    return table(spark, sf, "records", "title", "abstract_or_snippet").groupBy(calibration.signal_tier(text).alias("tier")).agg(F.count("*").alias("records"))


_SYSTEMS = "list_transform(string_split(coalesce({0},''),'|'), lambda x: trim(x))"
_STRATUM = "case when list_contains(d,'Grey literature') then 'GREY_LITERATURE' when list_contains(d,'Web of Science') then 'WEB_OF_SCIENCE' when list_contains(d,'Citation chaining') then 'CITATION_CHAINING' when list_contains(d,'OpenAlex') and list_contains(d,'Semantic Scholar') then 'MULTI_SCHOLARLY' when list_contains(d,'OpenAlex') then 'OPENALEX' when list_contains(d,'Semantic Scholar') then 'SEMANTIC_SCHOLAR' else 'OTHER' end"


@query(f"select calibration_record_id, loaded_at, {_STRATUM} as stratum from (select calibration_record_id, loaded_at, {_SYSTEMS.format('discovery_systems')} d from benchmark_validation_blinded)")
def source_stratum(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark_validation_blinded", "calibration_record_id", "loaded_at", "discovery_systems").select("calibration_record_id", "loaded_at", calibration.system_stratum(F.col("discovery_systems")).alias("stratum"))


_FAMILIES = calibration.FAMILY_ORDER
_HELD = "list_filter(list_transform(string_split(coalesce(family,''),'|'), lambda x: trim(x)), lambda x: list_contains([" + ",".join(f"'{f}'" for f in _FAMILIES) + "], x))"


@query(f"select occurrence_id, coalesce(list_min(list_transform({_HELD}, lambda x: sha256('{SEED}|family|'||occurrence_id||'|'||x)||x))[65:], 'OTHER') as primary_family from records")
def primary_family(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "records", "occurrence_id", "family").select("occurrence_id", calibration.primary_family(F.col("family"), F.col("occurrence_id"), SEED).alias("primary_family"))


@query(f"""
with r as (select occurrence_id, coalesce(nullif(upper(trim(coalesce(document_type,''))),''),'MISSING') t from records),
q as (select occurrence_id, t, row_number() over (partition by t order by sha256('{SEED}|ensure|level|'||t||'|'||occurrence_id)) n from r)
select occurrence_id, t as level from q where n<=5""")
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    """At least five rows of every document type, in stable order."""
    kind = F.upper(F.trim(F.coalesce("document_type", F.lit(""))))
    rows = table(spark, sf, "records", "occurrence_id", "document_type").select("occurrence_id", F.coalesce(F.nullif(kind, F.lit("")), F.lit("MISSING")).alias("level"), F.lit(False).alias("taken"))
    return sampling.ensure_levels(rows, "level", 5, SEED, "occurrence_id").where("taken").select("occurrence_id", "level")


@query(f"""
with r as (select doc_id::varchar id, coalesce(nullif(lower(trim(coalesce(lang,''))),''),'none') l, coalesce(nullif(lower(trim(coalesce(source,''))),''),'none') s from documents),
b as (select *, l||'|'||s k from r),
t as (select *, row_number() over (partition by k order by sha256('{SEED}|bucket|'||k||'|'||id)) turn from b),
p as (select *, row_number() over (order by turn, sha256('{SEED}|'||k)) place from t)
select id, l as lang, s as source from p where place<=400""")
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    """400 documents, one of each language and source in turn."""
    plain = lambda c: F.coalesce(F.nullif(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("")), F.lit("none"))
    rows = table(spark, sf, "documents", "doc_id", "lang", "source").select(F.col("doc_id").cast("string").alias("id"), plain("lang").alias("lang"), plain("source").alias("source"), F.lit(False).alias("taken"))
    return sampling.round_robin(rows, ["lang", "source"], 400, SEED, "id").where("taken").select("id", "lang", "source")


@query(f"""
with d as (select distinct calibration_record_id id from benchmark_validation_blinded),
r as (select id, row_number() over (order by sha256('{SEED}|validation-split|'||id)) n from d)
select id, case when n<=100 then 'VALIDATION' else 'DEVELOPMENT' end as split from r""")
def validation_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark_validation_blinded", "calibration_record_id").select(F.col("calibration_record_id").alias("id")).distinct()
    return sampling.locked_split(rows, 100, SEED, "id")


@query("select coalesce(source,'') as level, count(*) as rows from documents group by 1 order by 2 desc, 1 limit 12")
def top_k_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve most frequent sources (a top-k report)."""
    return sampling.top_levels(table(spark, sf, "documents", "source").select(F.coalesce("source", F.lit("")).alias("level")), "level", 12)


@query("select l_partkey as part, count(distinct l_suppkey) as suppliers, count(distinct l_orderkey) as orders from lineitem group by 1 having count(distinct l_suppkey)>=2 or count(distinct l_orderkey)>=3")
def graph_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_orderkey").groupBy(F.col("l_partkey").alias("part")).agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_orderkey").alias("orders")).where("suppliers >= 2 or orders >= 3")


_WORKS = "select p_partkey w, list_filter([p_partkey*7%n+1, p_partkey*11%n+1], lambda x: x<>p_partkey) refs, list_filter([p_partkey*13%n+1], lambda x: x<>p_partkey) rel, p_size from part, (select count(*) n from part)"


def _works(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts as a synthetic citation graph: references and related works by arithmetic on the key."""
    parts = table(spark, sf, "part", "p_partkey", "p_size")
    n = F.broadcast(parts.agg(F.count("*").alias("n")))
    at = lambda k: F.col("p_partkey") * k % F.col("n") + 1
    other = lambda v: v != F.col("p_partkey")
    works = parts.crossJoin(n).select(F.col("p_partkey").alias("work_id"), F.filter(F.array(at(7), at(11)), other).alias("referenced_works"), F.filter(F.array(at(13)), other).alias("related_works"), "p_size")
    return works, works.where("p_size <= 5").select("work_id")


_GEN = """{n} as (select s.w parent, unnest(s.refs) child, 'BACKWARD_REFERENCE' route from w s where s.w in (select w from {f}) union all select s.w, unnest(s.rel), 'RELATED_WORK' from w s where s.w in (select w from {f})
union all select x.c, x.w, 'FORWARD_CITATION' from (select w, unnest(refs) c from w) x where x.c in (select w from {f})),
{n}d as (select distinct parent, child, route from {n} where child in (select w from w))"""
_TWO = f"with w as ({_WORKS}), s1 as (select w from w where p_size<=5), {_GEN.format(n='g1', f='s1')}, s2 as (select child w from g1d group by 1 having (count(distinct parent)>=2 or count(distinct route)>=2) and child not in (select w from s1) and child in (select w from w where p_size<=40)), {_GEN.format(n='g2', f='s2')}, e as (select *, 1 generation from g1d union all select *, 2 from g2d)"


@query(f"{_TWO} select parent, child, route, generation from e")
def graph_two_generation(spark: SparkSession, sf: str) -> DataFrame:
    works, seeds = _works(spark, sf)
    return graph.expand_twice(works, seeds, seeds, F.col("p_size") <= 40)


@query(f"{_TWO} select child, string_agg(distinct route, ' | ' order by route) as routes, string_agg(distinct generation::varchar, ' | ' order by generation::varchar) as generations, count(distinct parent) as parents from e group by 1")
def edge_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return graph.evidence(graph_two_generation(spark, sf))


@query("""
with old as (select o_custkey k, max(o_totalprice) v from orders where o_orderstatus<>'F' group by 1), new as (select o_custkey k, max(o_totalprice) v from orders where o_orderstatus='F' group by 1)
select k as query_id, v as value from old where k not in (select k from new) union all select k, v from new""")
def search_log_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders", "o_custkey", "o_totalprice", "o_orderstatus")
    side = lambda c: rows.where(c).groupBy(F.col("o_custkey").alias("query_id")).agg(F.max("o_totalprice").alias("value"))
    return files.upsert(side("o_orderstatus <> 'F'"), side("o_orderstatus = 'F'"))


@query("select user_id, arg_min(event_id,(ts,event_id)) as event_id, min(ts) as ts from events group by 1")
def first_seen_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events", "event_id", "ts", "user_id").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.event_id", "m.ts")


@query(f"select doc_id, true as same, length({_sql(_CLEAN, 'text')}) as chars from documents")
def inverted_index_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Texts taken apart into word positions and put together again; ``same`` must hold."""
    rows = table(spark, sf, "documents", "doc_id", "text")
    rebuilt = X.inverted_index(rows, "doc_id", "text").select("doc_id", X.rebuild_abstract(F.col("index")).alias("rebuilt"))
    both = rows.select("doc_id", X.clean(F.col("text")).alias("clean")).join(rebuilt, "doc_id")
    return both.select("doc_id", (F.col("rebuilt") == F.col("clean")).alias("same"), F.length("rebuilt").alias("chars"))


# A query of each dialect.
SEARCHES = {
    "wos": ('TS=(("sea pen*" OR coral* OR gorgonian*) AND (sediment* OR "dredge spoil" OR tailings))', False),
    "scholar": '(sponge* | "glass sponges") + (drill* | "barite-laden mud")',
    "stemmed": ('(sponge OR coral) AND ("fine tailing" OR clay)', True),
    "web": 'coral plume*',
}
_W = lambda p: f"regexp_matches(t,'(^|[^\\pL\\pN])(?:{p})($|[^\\pL\\pN])')"


@query(f"""
with d as (select doc_id, lower(coalesce(text,'')) t from documents)
select doc_id, ({_W('sea[^\\pL\\pN]+pen[\\pL\\pN]*')} or {_W('coral[\\pL\\pN]*')} or {_W('gorgonian[\\pL\\pN]*')}) and ({_W('sediment[\\pL\\pN]*')} or {_W('dredge[^\\pL\\pN]+spoil')} or {_W('tailings')}) as wos,
({_W('sponge[\\pL\\pN]*')} or {_W('glass[^\\pL\\pN]+sponges')}) and ({_W('drill[\\pL\\pN]*')} or {_W('barite[^\\pL\\pN]+laden[^\\pL\\pN]+mud')}) as scholar,
({_W('sponge[\\pL\\pN]*')} or {_W('coral[\\pL\\pN]*')}) and ({_W('fine[\\pL\\pN]*[^\\pL\\pN]+tailing[\\pL\\pN]*')} or {_W('clay[\\pL\\pN]*')}) as stemmed,
{_W('coral')} and {_W('plume[\\pL\\pN]*')} as web from d""")
def boolean_search(spark: SparkSession, sf: str) -> DataFrame:
    found = [(q if isinstance(q, tuple) else (q, False), n) for n, q in SEARCHES.items()]
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", *[search.matches(q, F.col("text"), stemmed).alias(n) for (q, stemmed), n in found])


@query("""
with w as (select doc_id, unnest(string_split(trim(regexp_replace(lower(coalesce(text,'')),'[^\\pL\\pN]+',' ','g')),' ')) w, generate_subscripts(string_split(trim(regexp_replace(lower(coalesce(text,'')),'[^\\pL\\pN]+',' ','g')),' '),1) i from documents),
a as (select doc_id, i from w where w in ('recovery','recovered')), b as (select doc_id, i from w where regexp_full_match(w,'coral[\\pL\\pN]*'))
select distinct a.doc_id from a join b on a.doc_id=b.doc_id and abs(a.i-b.i)<=10""")
def near_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text").where(search.matches("(recovery OR recovered) NEAR/10 coral*", F.col("text"))).select("doc_id")


@query("""select (select count(*) from records) as occurrences, (select count(distinct occurrence_id)=count(*) from records) as unique_ids, (select bool_and(loaded_at is not null) from records) as all_loaded,
(select bool_or(title is null) from records) as any_untitled, (select count(distinct url) from records where coalesce(url,'')<>'') as urls, (select max(retrieved_date) from records) as last_retrieved""")
def qa_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "records", "occurrence_id", "title", "url", "retrieved_date", "loaded_at")
    return export.checks(rows, {"occurrences": F.count("*"), "unique_ids": F.countDistinct("occurrence_id") == F.count("*"), "all_loaded": F.bool_and(F.col("loaded_at").isNotNull()), "any_untitled": F.bool_or(F.col("title").isNull()), "urls": F.countDistinct(F.when(F.col("url") != "", F.col("url"))), "last_retrieved": F.max("retrieved_date")})


_RISCLEAN = lambda c: f"trim(regexp_replace(coalesce({c},''),'[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1680}}\\x{{2028}}\\x{{2029}}\\x{{0085}}\\x{{001c}}-\\x{{001f}}]+',' ','g'))"
_LINE = lambda t, c: f"case when {_RISCLEAN(c)}<>'' then '{t}  - '||{_RISCLEAN(c)} end"
_LINES = lambda t, c: f"nullif(array_to_string(list_transform(list_filter(list_transform(string_split(coalesce({c},''),'|'), lambda x: {_RISCLEAN('x')}), lambda x: x<>''), lambda x: '{t}  - '||x), chr(13)||chr(10)),'')"
_TYPE = "case " + " ".join(f"when {'contains(k,' + chr(39) + 'conference' + chr(39) + ') or ' if code == 'CPAPER' else ''}k in (" + ",".join(f"'{n}'" for n in names) + f") then '{code}'" for code, names in export.RIS_TYPES) + " else 'GEN' end"


@query(f"""select calibration_record_id, loaded_at, concat_ws(chr(13)||chr(10), 'TY  - '||{_TYPE}, 'TI  - '||case when {_RISCLEAN('title')}<>'' then {_RISCLEAN('title')} else '[Untitled record '||coalesce(corpus_id,'')||']' end, {_LINES('AU', 'authors')}, {_LINE('PY', 'year::varchar')}, {_LINE('JO', 'source_title_or_issuer')}, {_LINE('DO', 'doi')}, {_LINE('UR', 'url')}, {_LINE('LA', 'language')}, {_LINE('AB', 'screening_text')}, {_LINES('KW', 'families')}, {_LINE('AN', 'corpus_id')}, 'DB  - calibration', 'N1  - '||{_RISCLEAN("'corpus_id='||coalesce(corpus_id,'')")}, 'N1  - '||{_RISCLEAN("'full_text_status='||coalesce(full_text_status,'')")}, 'ER  -') as ris
from (select *, lower({_RISCLEAN('document_type')}) k from benchmark_validation_blinded)""")
def ris_export(spark: SparkSession, sf: str) -> DataFrame:
    """Every screening record as tagged text."""
    rows = table(spark, sf, "benchmark_validation_blinded", "corpus_id", "title", "authors", "year", "source_title_or_issuer", "document_type", "doi", "url", "language", "screening_text", "families", "full_text_status", "calibration_record_id", "loaded_at")
    fields = {"id": F.col("corpus_id"), "title": F.col("title"), "authors": F.col("authors"), "year": F.col("year"), "journal": F.col("source_title_or_issuer"), "document_type": F.col("document_type"), "doi": F.col("doi"), "url": F.col("url"), "language": F.col("language"), "abstract": F.col("screening_text"), "keywords": F.col("families"), "full_text_status": F.col("full_text_status")}
    return rows.select("calibration_record_id", "loaded_at", export.ris_text(fields, "calibration").alias("ris"))


@query(f"""select calibration_record_id, loaded_at, case when {_RISCLEAN('title')}<>'' then {_RISCLEAN('title')} else '[Untitled record '||coalesce(corpus_id,'')||']' end as title, len(list_filter(list_transform(string_split(coalesce(authors,''),'|'), lambda x: {_RISCLEAN('x')}), lambda x: x<>''))::int as authors from benchmark_validation_blinded""")
def ris_import(spark: SparkSession, sf: str) -> DataFrame:
    """The export read again: titles must come back."""
    back = ris_export(spark, sf).select("calibration_record_id", "loaded_at", F.explode(files.parse_tagged(F.col("ris"))).alias("tags"))
    return back.select("calibration_record_id", "loaded_at", F.get(F.col("tags")["TI"], 0).alias("title"), F.size(F.coalesce(F.col("tags")["AU"], F.array())).alias("authors"))


@query("""
with b as (select row_number() over (order by target_id) i, target_id, target_name, trim(unnest(string_split(domains,'|'))) d from grey_institutional_targets where lower(trim(status))='active'),
f as (select distinct family f from records where family not like '%|%' and coalesce(family,'')<>'')
select 'GL_'||target_id||'_'||f||'_02' as query_id, target_id, f as family, count(distinct d)::bigint as domains from b, f where d<>'' group by all""")
def target_cross(spark: SparkSession, sf: str) -> DataFrame:
    targets = files.load_targets(table(spark, sf, "grey_institutional_targets"))
    families = table(spark, sf, "records", "family").where("coalesce(family, '') <> '' and not contains(family, '|')").distinct()
    return files.target_queries(targets, families).select("query_id", "target_id", "family", F.size(F.array_distinct("domains")).cast("bigint").alias("domains"))


@query("select doc_id, text is not null and contains(lower(text), 'tailings') as flag, concat_ws(',', case when contains(lower(coalesce(text,'')),'coral') then 'coral' end, case when contains(lower(coalesce(text,'')),'sponge') then 'sponge' end) as leaked from documents")
def blinding_check(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.coalesce(F.lower(t).contains("tailings"), F.lit(False)).alias("flag"), F.array_join(export.leaks(t, ("coral", "sponge")), ",").alias("leaked"))


@query("select event_type, date_trunc('day', ts) as window_start, count(*) as n from events group by 1,2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    from tidewrack.streaming.upserts import windowed_counts

    return windowed_counts(table(spark, sf, "events", "ts", "event_type"), "ts", "event_type").select("event_type", "window_start", "n")


@query("select query_id, occurrence_id, row_number() over (partition by query_id order by retrieved_date nulls first, occurrence_id) as result_rank from records")
def result_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "records", "query_id", "occurrence_id", "retrieved_date")
    order = Window.partitionBy("query_id").orderBy(F.col("retrieved_date").asc_nulls_first(), "occurrence_id")
    return rows.select("query_id", "occurrence_id", F.row_number().over(order).alias("result_rank"))


@query(f"select occurrence_id, 'CWC-'||upper(sha1('doi:'||{_sql(_DOI, 'doi')})[1:12]) as corpus_id, sha256(coalesce(title,'')) as title_digest from records where {_sql(_DOI, 'doi')}<>''")
def corpus_ids(spark: SparkSession, sf: str) -> DataFrame:
    doi = X.normalize_doi(F.col("doi"))
    empty = F.lit("")
    return table(spark, sf, "records", "occurrence_id", "doi", "title").select("occurrence_id", doi.alias("d"), F.sha2(F.coalesce("title", empty), 256).alias("title_digest")).where("d <> ''").select("occurrence_id", X.corpus_id(F.col("d"), empty, empty, empty).alias("corpus_id"), "title_digest")
