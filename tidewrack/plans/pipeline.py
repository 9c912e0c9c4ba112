"""Queries of whole stages of the pipeline: recovery, chaining, calibration, web results, sources, checks.

Registered with those of ``reference``; SQL stands beside each where SQL can say it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import text as X
from tidewrack.functions import unicode as U
from tidewrack.operators import calibration, chaining, export, grey, recovery, search
from tidewrack.plans.reference import _CLEAN, _DOI, _DOMAIN, _HELD, _KEY, _STRATUM, _SYSTEMS, _TIER, SEED, _sql, query
from tidewrack.session import Scratch, table
from tidewrack.sources import files

_ADDRESS = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)'"


def _bare(column: str) -> str:
    """The bare form of an address that has a scheme and a host, as SQL; '' for others."""
    c = _sql(_CLEAN, column)
    return f"case when regexp_matches({c},'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') then lower(regexp_extract({c},{_ADDRESS},1))||'://'||lower(regexp_extract({c},{_ADDRESS},2))||regexp_replace(regexp_extract({c},{_ADDRESS},3),'/+$','') else '' end"


def _bare_address(c: str):  # noqa: ANN202
    return U.let(X.clean_space(F.col(c)), lambda v: F.when(v.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), X.bare_url(v)).otherwise(""))


def _index(c: str = "occurrence_id"):  # noqa: ANN202
    return F.regexp_extract(c, r"(\d+)", 1).cast("long")


# --- recovery -----------------------------------------------------------------------------------

_KNOWN = f"""
with k as (select distinct paper_id known_id, {_sql(_DOI, 'doi')} d, {_bare('url')} u, {_KEY} t, regexp_replace({_KEY},'^(the|a|an) ','') alias_t from ss_mech_feeding_pumping_sponge_01),
c as (select occurrence_id corpus_id, {_sql(_DOI, 'doi')} d, {_bare('url')} u, {_KEY} t, coalesce(query_id,'') q from records),
e as (select known_id, corpus_id, 100 score, 'DOI' b from k join c using (d) where d<>'' union all select known_id, corpus_id, 95, 'CANONICAL_URL' from k join c using (u) where u<>'' union all select known_id, corpus_id, 90, 'EXACT_TITLE' from k join c using (t) where t<>'' union all select known_id, corpus_id, 80, 'RESOLVED_ALIAS_TITLE' from k join c on alias_t=c.t where alias_t<>''),
v as (select known_id, corpus_id, max(score) score, string_agg(distinct b, ' | ' order by b) basis from e group by 1,2)"""


def _known(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Papers of the sponge table as known items (their titles without an article as aliases), and the records as the corpus."""
    title = X.normalize_text(F.col("title"))
    sponge = table(spark, sf, "ss_mech_feeding_pumping_sponge_01", "paper_id", "doi", "url", "title")
    known = sponge.select(F.col("paper_id").alias("known_id"), X.normalize_doi(F.col("doi")).alias("doi"), _bare_address("url").alias("url"), title.alias("norm_title"), F.regexp_replace(title, "^(the|a|an) ", "").alias("alias_title")).distinct()
    records = table(spark, sf, "records", "occurrence_id", "doi", "url", "title", "query_id")
    corpus = records.select(F.col("occurrence_id").alias("corpus_id"), X.normalize_doi(F.col("doi")).alias("doi"), _bare_address("url").alias("url"), title.alias("norm_title"), F.coalesce("query_id", F.lit("")).alias("query_ids"))
    return known, corpus


@query(f"{_KNOWN} select * from v")
def benchmark_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Exact evidence of every kind for known items."""
    return recovery.exact_evidence(*_known(spark, sf))


_STATUS = f"""{_KNOWN},
m as (select known_id, arg_min(corpus_id, (-score, corpus_id)) corpus_id, arg_min(basis, (-score, corpus_id)) basis from v group by 1),
s as (select i.known_id, case when m.corpus_id is null then 'NOT_RECOVERED' else 'RECOVERED' end recovery_status, coalesce(m.basis,'NO_EXACT_MATCH') match_basis, coalesce(m.corpus_id,'') matched_corpus_id, coalesce(len(list_filter(list_transform(string_split(c.q,'|'), lambda x: trim(x)), lambda x: x<>''))>0,false) independently_recovered
from (select distinct known_id from k) i left join m using (known_id) left join c on c.corpus_id=m.corpus_id)"""


@query(f"{_STATUS} select * from s")
def recovery_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every known item with its best match and status."""
    return recovery.recovery_status(*_known(spark, sf))


@query(f"""{_STATUS} select kind, count(*) as total, count_if(recovery_status='RECOVERED')::bigint as initially_recovered, count_if(recovery_status='RECOVERED_AFTER_REMEDIATION')::bigint as recovered_after_remediation, count_if(recovery_status<>'NOT_RECOVERED')::bigint as accounted
from s join (select paper_id known_id, min(coalesce(venue,'')) kind from ss_mech_feeding_pumping_sponge_01 group by 1) using (known_id) group by 1""")
def recovery_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Recovery per kind of known item."""
    kinds = table(spark, sf, "ss_mech_feeding_pumping_sponge_01", "paper_id", "venue").groupBy(F.col("paper_id").alias("known_id")).agg(F.min(F.coalesce("venue", F.lit(""))).alias("kind"))
    return recovery.recovery_counts(recovery_status(spark, sf), kinds)


def _targets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    known = table(spark, sf, "grey_institutional_targets", "target_id", "target_name").select(F.col("target_id").alias("known_id"), X.normalize_text(F.col("target_name")).alias("norm_title"))
    return known, table(spark, sf, "records", "occurrence_id", "title").select(F.col("occurrence_id").alias("corpus_id"), X.normalize_text(F.col("title")).alias("norm_title"))


@query()
def benchmark_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The title with the greatest sequence ratio to the name of every target."""
    return recovery.nearest_title(*_targets(spark, sf)).withColumn("similarity", F.round("similarity", 4))


@query(f"""with k as (select target_id known_id, list_distinct(string_split(trim(regexp_replace(lower(coalesce(target_name,'')),'[^a-z0-9]+',' ','g')),' ')) a from grey_institutional_targets),
c as (select occurrence_id corpus_id, list_distinct(string_split({_KEY},' ')) b from records where {_KEY}<>''),
s as (select known_id, corpus_id, len(list_intersect(a,b))/(len(a)+len(b)-len(list_intersect(a,b))) s from k, c)
select known_id, arg_min(corpus_id,(-s,corpus_id)) as corpus_id, round(max(s),6) as similarity from s where s>0 group by 1""")
def benchmark_nearest_words(spark: SparkSession, sf: str) -> DataFrame:
    """The title with the largest share of common words with the name of every target."""
    return recovery.nearest_words(*_targets(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query()
def recovery_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Targets whose name is no title: the nearest one, and what to do."""
    known, corpus = _targets(spark, sf)
    whole = corpus.select("corpus_id", F.lit("").alias("doi"), F.lit("").alias("url"), "norm_title", F.lit("q").alias("query_ids"))
    kinds = table(spark, sf, "grey_institutional_targets", "target_id", "status").select(F.col("target_id").alias("known_id"), F.coalesce("status", F.lit("")).alias("kind"))
    return recovery.diagnostics(recovery.recovery_status(known, whole), recovery.nearest_title(known, corpus), kinds, "active")


_AIM = f"(select query_id, arg_min(title, occurrence_id) title, arg_min(url, occurrence_id) url from (select query_id, occurrence_id, coalesce(title,'') title, coalesce(url,'') url from records) group by 1)"


@query(f"""
with r as (select query_id, occurrence_id, {_KEY} t, {_bare('url')} u, array_to_string(string_split({_sql(_CLEAN, 'abstract_or_snippet')},' ')[1:20],' ') content, row_number() over (partition by query_id order by retrieved_date nulls first, occurrence_id) as result_rank from records),
a as (select query_id, {_KEY} t, {_bare('url')} u from {_AIM}),
f as (select r.query_id, occurrence_id, result_rank, content, r.t=a.t exact_target_title, r.u=a.u exact_target_url from r join a using (query_id))
select *, result_rank = min(result_rank) filter (exact_target_title or exact_target_url) over (partition by query_id) as first_match from f""")
def remediation_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Results of every query, ranked, against a target: its first record."""
    whole = lambda c: F.coalesce(c, F.lit(""))
    results = table(spark, sf, "records", "query_id", "occurrence_id", "title", "url", "abstract_or_snippet", "retrieved_date").withColumnRenamed("abstract_or_snippet", "content").withColumn("url", _bare_address("url"))
    targets = results.groupBy("query_id").agg(F.min_by(whole("title"), "occurrence_id").alias("title"), F.min_by("url", "occurrence_id").alias("url"))
    flagged = recovery.target_flags(results, targets, [F.col("retrieved_date").asc_nulls_first(), F.col("occurrence_id").asc()])
    return flagged.select("query_id", "occurrence_id", "result_rank", "content", "exact_target_title", "exact_target_url", "first_match")


@query()
def frozen_page(spark: SparkSession, sf: str) -> DataFrame:
    """The line of every document most like a target, and whether it holds it."""
    pages = table(spark, sf, "documents", "doc_id", "text", "source").select(F.col("doc_id").alias("page_id"), F.col("text").alias("content"), F.concat(F.lit("https://"), F.coalesce("source", F.lit("")), F.lit(".example/")).alias("url"))
    return recovery.best_line(pages, "sponges after dredging", "example")


# --- chaining -----------------------------------------------------------------------------------

_PROMISE = lambda t: f"(regexp_matches({t},'{_org}') and regexp_matches({t},'{_str}'))"
_org = r"(?i)(?:^|[^\pL\pN_])(?:coral|corals|octocoral|gorgonian|sea pen|scleractinian|antipatharian|black coral|sponge|sponges|porifera|demosponge|hexactinellid|glass sponge)(?:$|[^\pL\pN_])"
_str = r"(?i)(?:^|[^\pL\pN_])(?:sediment|sedimentation|suspended solids|turbidity|burial|smother|drill cuttings|drilling mud|dredg|tailings|resuspension|particle loading|mucus|mucociliary|pumping|filtration|food capture)"


def _chain_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Records as a citation graph, references by arithmetic on their number, and as a corpus, one row per plain title."""
    empty = F.lit("")
    records = table(spark, sf, "records", "occurrence_id", "system", "title", "doi", "family", "year", "publication_date", "document_type", "language", "authors", "source_title", "url", "abstract_or_snippet", "full_text_status").withColumn("i", _index())
    n = F.broadcast(records.agg(F.max("i").alias("n")))  # one row
    at = lambda k: F.concat(F.lit("W"), F.col("i") * k % F.col("n") + 1)
    me = F.concat(F.lit("W"), "i")
    other = lambda a: F.filter(a, lambda v: v != me)
    works = records.crossJoin(n).select(
        me.alias("work_id"), "doi", "title", "year", "publication_date", F.col("document_type").alias("work_type"), "language", "authors", F.col("source_title").alias("source"), F.col("url").alias("landing_page_url"), F.lit("").alias("pdf_url"), (F.col("full_text_status") == "OPEN_ACCESS_LANDING_PAGE").alias("is_oa"),
        (F.col("i") % 50).alias("cited_by_count"), F.substring(F.coalesce("abstract_or_snippet", empty), 1, 100).alias("abstract"), other(F.array(at(7), at(11))).alias("referenced_works"), other(F.array(at(13))).alias("related_works"),
    )
    packed = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(c), empty))), " | ")
    key = X.normalize_text(F.col("title"))
    corpus = records.where(key != "").groupBy(key.alias("k")).agg(F.concat(F.lit("C"), F.min("i")).alias("corpus_id"), F.min_by(F.coalesce("title", empty), "i").alias("title"), F.min_by(F.coalesce("doi", empty), "i").alias("doi"), packed("family").alias("families"), packed(F.upper("system")).alias("discovery_systems"), F.count("*").alias("occurrence_count"), F.array_join(F.array_sort(F.collect_set(F.when(F.upper(F.trim("system")) == "OPENALEX", me))), " | ").alias("source_record_ids"))
    return corpus.drop("k"), works


_STRIP = lambda c: f"regexp_replace(regexp_replace(lower({_sql(_CLEAN, c)}),'^(https?://)?(dx\\.)?doi\\.org/',''),'[.,;:)\\]}}]+$','')"
_CHAIN = f"""
with r as (select *, cast(regexp_extract(occurrence_id,'(\\d+)',1) as bigint) i, {_KEY} k from records), n as (select max(i) n from r),
w as (select 'W'||i w, i, coalesce(title,'') title, {_STRIP('doi')} d, list_filter(['W'||(i*7%n+1), 'W'||(i*11%n+1)], lambda x: x<>'W'||i) refs, list_filter(['W'||(i*13%n+1)], lambda x: x<>'W'||i) rel from r, n),
c as (select 'C'||min(i) corpus_id, arg_min(coalesce(title,''), i) title, arg_min(coalesce(doi,''), i) doi, coalesce(string_agg(distinct nullif(trim(family),''), ' | ' order by nullif(trim(family),'')),'') families, coalesce(string_agg(distinct nullif(trim(upper(system)),''), ' | ' order by nullif(trim(upper(system)),'')),'') systems, count(distinct nullif(trim(upper(system)),'')) ns, count(*) n, list_distinct(list('W'||i) filter (upper(trim(system))='OPENALEX')) ids from r where k<>'' group by k),
st as (select * from c where (ns>=2 or n>=3) and {_PROMISE('title')}),
dw as (select d, min(w) w from w where d<>'' group by 1),
sd as (select corpus_id, title, doi, families, systems, n, unnest(ids) w from st where len(ids)>0 union all select corpus_id, title, doi, families, systems, n, w from (select *, {_STRIP('doi')} d from st where coalesce(len(ids),0)=0 and doi<>'') join dw using (d)),
ex as (select distinct unnest(ids) w from c),
e1 as (select distinct parent, child, route from (select w parent, unnest(refs) child, 'BACKWARD_REFERENCE' route from w where w in (select w from sd) union all select w, unnest(rel), 'RELATED_WORK' from w where w in (select w from sd) union all select p, w, 'FORWARD_CITATION' from (select w, unnest(refs) p from w) where p in (select w from sd)) where child in (select w from w)),
s2 as (select child w from e1 where child not in (select w from ex) and child in (select w from w where {_PROMISE('title')}) group by 1 having count(distinct parent)>=2 or count(distinct route)>=2),
e2 as (select distinct parent, child, route from (select w parent, unnest(refs) child, 'BACKWARD_REFERENCE' route from w where w in (select w from s2) union all select w, unnest(rel), 'RELATED_WORK' from w where w in (select w from s2) union all select p, w, 'FORWARD_CITATION' from (select w, unnest(refs) p from w) where p in (select w from s2)) where child in (select w from w)),
e as (select 1 generation, * from e1 union all select 2, * from e2),
o as (select parent, corpus_id, f from (select w parent, corpus_id, unnest(string_split(families,' | ')) f from sd) union select w, 'CHAIN_GENERATION_1:'||w, null from s2 union select e1.child, 'CHAIN_GENERATION_1:'||e1.child, f from e1 join s2 on e1.child=s2.w join (select w, unnest(string_split(families,' | ')) f from sd) x on x.w=e1.parent)"""


def _chained(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return chaining.chain(*_chain_tables(spark, sf))


@query(f"{_CHAIN} select 0 as seed_generation, corpus_id, title, doi, families, systems as discovery_systems, n as occurrence_count, w as work_id, '{chaining.SEED_BASIS}' as seed_basis from sd")
def chain_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Promising, strongly found titles under their works."""
    return chaining.primary_seeds(*_chain_tables(spark, sf))[0]


@query(f"""{_CHAIN} select e.generation, e.route, e.parent as parent_work_id, coalesce((select string_agg(distinct corpus_id, ' | ' order by corpus_id) from o where o.parent=e.parent),'{chaining.NO_PARENT}') as parent_corpus_ids, e.child as discovered_work_id, coalesce((select string_agg(distinct f, ' | ' order by f) from o where o.parent=e.parent),'') as inherited_families from e""")
def chain_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of two generations with what their parents hand down."""
    edges = _chained(spark, sf)["edges"]
    return edges.select("generation", "route", "parent_work_id", chaining.joined(F.col("corpus_ids")).alias("parent_corpus_ids"), "discovered_work_id", chaining.joined(F.col("families")).alias("inherited_families"))


@query(f"""{_CHAIN} select child as work_id, string_agg(distinct 'OA_CHAIN_G'||generation||'_'||route, ' | ' order by 'OA_CHAIN_G'||generation||'_'||route) as query_ids, string_agg(distinct generation::varchar, ' | ' order by generation::varchar) as generations, string_agg(distinct route, ' | ' order by route) as routes, count(distinct parent)::int as parent_count,
(child in (select w from ex) or any_value(w.d) in (select {_STRIP('doi')} from c where {_STRIP('doi')}<>'')) as already_in_candidate_corpus, any_value({_sql(_CLEAN, 'w.title')}) as title, coalesce((select string_agg(distinct f, ' | ' order by f) from o where o.parent in (select parent from e x where x.child=e.child)),'') as families from e join w on w.w=e.child group by child""")
def chain_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Discovered works with their evidence."""
    return _chained(spark, sf)["candidates"].select("work_id", "query_ids", "generations", "routes", "parent_count", "already_in_candidate_corpus", "title", "families")


@query(f"{_CHAIN} select route, generation, count(*) as edges, count(distinct child) as works from e group by 1,2")
def chain_counts(spark: SparkSession, sf: str) -> DataFrame:
    return chaining.chain_counts(_chained(spark, sf)["edges"])


@query(f"""{_CHAIN}, g as (select distinct child from e)
select (select count(*) from e) as citation_edges, true as generation_cap_respected, true as all_edges_have_parent_and_child, (select count(*) from sd) as primary_seed_rows, (select count(distinct w) from sd) as primary_seed_works, (select count(*) from g) as unique_discovered_works,
(select count(*) from g join w on w.w=child where child in (select w from ex) or w.d in (select {_STRIP('doi')} from c where {_STRIP('doi')}<>'')) as already_present_before_merge, (select count(*) from s2) as generation_2_seed_works, (select count(*) from st where corpus_id not in (select corpus_id from sd)) as unresolved_seed_candidates, true as all_discovered_ids_have_metadata,
(select count(*) from g join w on w.w=child where not (child in (select w from ex) or w.d in (select {_STRIP('doi')} from c where {_STRIP('doi')}<>''))) as new_to_candidate_corpus_before_merge""")
def chain_qa(spark: SparkSession, sf: str) -> DataFrame:
    return chaining.chain_qa(_chained(spark, sf))


# --- calibration --------------------------------------------------------------------------------

_BENCH = "upper(trim(coalesce(system,'')))='BENCHMARK REMEDIATION'"
_STRIPPED = r"regexp_replace(coalesce(abstract_or_snippet,''),'^[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{1680}\x{2028}\x{2029}\x{0085}\x{001c}-\x{001f}]+|[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{1680}\x{2028}\x{2029}\x{0085}\x{001c}-\x{001f}]+$','','g')"


def _prepared_sql() -> str:
    family = f"coalesce(list_min(list_transform({_HELD}, lambda x: sha256('{SEED}|family|'||occurrence_id||'|'||x)||x))[65:], 'OTHER')"
    stratum = _STRATUM.replace("list_contains(d,", f"list_contains({_SYSTEMS.format('system')},")
    a = f"""a as (select occurrence_id id, {_BENCH} bench, {family} primary_family, {stratum} system_stratum, {_TIER} signal_tier, case when {_STRIPPED}<>'' then 'TITLE_ABSTRACT' else 'TITLE_ONLY' end metadata_stratum, case when full_text_status='NOT_IDENTIFIED' then 'NOT_IDENTIFIED' else 'IDENTIFIED' end full_text_bin,
upper(trim(coalesce(nullif(document_type,''),'MISSING')))[1:60] document_type_stratum, substring({_STRIPPED},1,{calibration.TEXT_CHARS}) screening_text, length({_STRIPPED})>{calibration.TEXT_CHARS} text_truncated from records)"""
    return f"with {a}, r as (select * from a where not bench), s0 as (select id from r where false)"


def _sample_sql() -> str:
    """The six passes and the fill as SQL, each pass from what those before it took."""
    out, last = [_prepared_sql()], "s0"
    for k, (field, minimum) in enumerate(calibration.PASSES, 1):
        allowed = "true"
        if field == "primary_family":
            allowed = f"{field} <> 'OTHER'"
        elif field == "document_type_stratum":
            allowed = f"{field} in (select {field} from r group by 1 order by count(*) desc, 1 limit {calibration.COMMON_TYPES})"
        free = f"(select id, {field} l, row_number() over (partition by {field} order by sha256('{SEED}|ensure|{field}|'||{field}||'|'||id)) n from r where id not in (select id from {last}) and {allowed})"
        have = f"(select {field} h, count(*) c from r where id in (select id from {last}) group by 1)"
        out.append(f"s{k} as materialized (select id from {last} union all select id from {free} left join {have} on l=h where n <= {minimum}-coalesce(c,0))")
        last = f"s{k}"
    key = "||'|'||".join(calibration.BUCKET)
    turn = f"(select id, b, row_number() over (partition by b order by sha256('{SEED}|bucket|'||b||'|'||id)) turn from (select id, {key} b from r where id not in (select id from {last})))"
    out.append(f"s9 as materialized (select id from {last} union all select id from (select id, row_number() over (order by turn, sha256('{SEED}|'||b)) place from {turn}) where place <= {calibration.SIZE}-(select count(*) from {last}))")
    out.append(f"""f as (select r.*, 'CAL-'||lpad((row_number() over (order by sha256('{SEED}|final-sample|'||id)))::varchar,4,'0') calibration_record_id, case when row_number() over (order by sha256('{SEED}|validation-split|'||id))<={calibration.VALIDATION} then 'VALIDATION' else 'DEVELOPMENT' end split from r join s9 using (id))""")
    return ", ".join(out)


_FIELDS = ("primary_family", "system_stratum", "signal_tier", "metadata_stratum", "full_text_bin", "document_type_stratum")


def _prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Records as corpus rows; those of the remediation are the known items that stay out of the sample."""
    rows = table(spark, sf, "records", "occurrence_id", "system", "family", "title", "abstract_or_snippet", "full_text_status", "document_type")
    bench = F.upper(F.trim(F.coalesce("system", F.lit("")))) == "BENCHMARK REMEDIATION"
    named = rows.select(F.col("occurrence_id").alias("corpus_id"), F.col("system").alias("discovery_systems"), F.col("family").alias("families"), "title", "abstract_or_snippet", "full_text_status", "document_type", bench.alias("bench"))
    return calibration.prepare(named, SEED), named.where("bench").select("corpus_id", F.concat(F.lit("B"), "corpus_id").alias("benchmark_id"), F.coalesce("document_type", F.lit("")).alias("expected_screening"))


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    rows, known = _prepared(spark, sf)
    return calibration.select(rows.join(known.select("corpus_id"), "corpus_id", "left_anti"), SEED)


@query(f"{_sample_sql()} select calibration_record_id, split, id as corpus_id, {', '.join(_FIELDS)}, screening_text, text_truncated from f")
def calibration_sample(spark: SparkSession, sf: str) -> DataFrame:
    """400 records by six quotas and a round-robin fill, numbered and split."""
    return _sampled(spark, sf).select("calibration_record_id", "split", "corpus_id", *_FIELDS, "screening_text", "text_truncated")


@query(f"{_sample_sql()} select field, level, count(*) as rows from (" + " union all ".join(f"select '{c}' as field, {c} as level from f" for c in (*_FIELDS, "split")) + ") group by 1,2")
def calibration_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the sample per stratum."""
    return calibration.strata_counts(_sampled(spark, sf))


_BLIND = f"{_prepared_sql()}, b as (select a.*, 'BV-'||lpad((row_number() over (order by sha256('{SEED}|benchmark|'||id)))::varchar,3,'0') rid from a where bench)"


@query(f"{_BLIND} select rid as calibration_record_id, id as corpus_id, 'BENCHMARK_VALIDATION' as split, screening_text, '' as human_decision, '' as reviewer from b")
def blinded_set(spark: SparkSession, sf: str) -> DataFrame:
    """The known items without what gives them away, with empty labels."""
    rows, known = _prepared(spark, sf)
    return calibration.blinded(rows.where("bench"), known, SEED)[0].select("calibration_record_id", "corpus_id", "split", "screening_text", "human_decision", "reviewer")


@query(f"{_BLIND} select rid as calibration_record_id, id as corpus_id, 'B'||id as benchmark_id, coalesce(document_type,'') as expected_screening from b join records on occurrence_id=id")
def benchmark_key(spark: SparkSession, sf: str) -> DataFrame:
    """What the blinded set leaves out."""
    rows, known = _prepared(spark, sf)
    return calibration.blinded(rows.where("bench"), known, SEED)[1]


@query(f"{_sample_sql()} select count(*) as sample_rows, count_if(split='DEVELOPMENT')::bigint as development_rows, count_if(split='VALIDATION')::bigint as validation_rows, (select count(*) from a where bench) as benchmark_validation_rows, count(*)={calibration.SIZE} as sample_size_met, count_if(split='VALIDATION')={calibration.VALIDATION} as validation_size_met, true as sample_corpus_ids_unique, true as benchmarks_excluded_from_calibration, true as human_labels_blank from f")
def calibration_qa(spark: SparkSession, sf: str) -> DataFrame:
    rows, known = _prepared(spark, sf)
    return calibration.calibration_qa(_sampled(spark, sf), calibration.blinded(rows.where("bench"), known, SEED)[0], known)


@query(f"select calibration_record_id, corpus_id, row_number() over (order by sha256('{SEED}-ris|'||corpus_id), calibration_record_id) as place from (select distinct calibration_record_id, corpus_id from benchmark_validation_blinded where coalesce(corpus_id,'')<>'')")
def ris_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """The order of the exported records; a sort by range, numbered without a global window."""
    rows = table(spark, sf, "benchmark_validation_blinded", "calibration_record_id", "corpus_id").where("coalesce(corpus_id, '') <> ''").distinct()
    placed = files.occurrence_ids(rows.withColumn("h", export.ris_order(F.col("corpus_id"), f"{SEED}-ris")), ["h", "calibration_record_id"])
    return placed.select("calibration_record_id", "corpus_id", (F.col("occ_idx") + 1).alias("place"))


@query("""with r as (select count(*) n, bool_and(coalesce(corpus_id,'')<>'') f, count(distinct corpus_id)=count(*) u from benchmark_validation_blinded)
select n as records, f as ids_filled, u as ids_unique, n::bigint as openings, n::bigint as endings, '' as leaked from r""")
def ris_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and leaks of the export."""
    from tidewrack.plans.reference import ris_export

    both = ris_export(spark, sf).select("calibration_record_id", "loaded_at", "ris")
    ids = table(spark, sf, "benchmark_validation_blinded", "calibration_record_id", "loaded_at", "corpus_id")
    return export.ris_checks(both.join(ids, ["calibration_record_id", "loaded_at"]), "ris", "corpus_id", ("expected_screening", "benchmark_id", "positive_core", "negative_tropical"))


# --- web results --------------------------------------------------------------------------------

_GREY = "upper(trim(regexp_replace(coalesce(system,''),'\\s+',' ','g')))='GREY LITERATURE'"


def _grey(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "records", "occurrence_id", "system", "query_id", "title", "url", "abstract_or_snippet", "document_type", "language")
    return rows.where(F.upper(F.trim(F.regexp_replace(F.coalesce("system", F.lit("")), r"\s+", " "))) == "GREY LITERATURE").where("coalesce(url, '') <> ''").withColumn("content", X.excerpt(F.col("abstract_or_snippet"))).drop("system", "abstract_or_snippet")


@query(f"select {_DOMAIN} as domain, count(*) as occurrences, min(occurrence_id) as first from records where {_GREY} and {_DOMAIN}<>'' group by 1")
def domain_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Domains of web results by frequency, equals as first seen."""
    return grey.domain_frequency(_grey(spark, sf).withColumn("domain", X.url_domain(F.col("url"))), "occurrence_id")


_ENRICH = f"""with g as (select occurrence_id, query_id, url, document_type, language, title, {_sql(_CLEAN, 'abstract_or_snippet')}[1:600] content from records where {_GREY} and coalesce(url,'')<>''),
u as (select url, min(occurrence_id) first from g group by 1), b as (select url, first, (row_number() over (order by first)-1)//20 batch, ((row_number() over (order by first)-1)%20)::varchar id from u),
n as (select b.*, g.document_type, g.language from b join g on g.occurrence_id=b.first where cast(id as int)%3<>0)
select g.occurrence_id, g.url, coalesce(n.document_type,'') as answer_document_type, coalesce(n.language,'') as answer_language, case when n.url is null then '{grey.UNANSWERED}' else '{grey.ANSWERED}' end as answer_status, b.batch from g join b using (url) left join n using (url)"""


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Web results with the answers of a stand-in for the model, which leaves out every third record of a batch."""
    rows = _grey(spark, sf)
    scratch = Scratch(spark, "grey")
    asked = scratch.keep(grey.batches(grey.first_by(rows, "url", "occurrence_id"), "occurrence_id", 20))
    answers = asked.where("cast(id as int) % 3 <> 0").select("batch", "id", F.lit(0).alias("place"), "document_type", F.lit(None).cast("string").alias("issuing_organization"), F.lit(None).cast("string").alias("publication_year"), "language", F.lit("uncertain").alias("full_document_guess"))
    out = grey.enrich(rows, asked.select("url", "batch", "id"), answers).join(asked.select("url", "batch"), "url")
    out._scratch = scratch
    return out


@query(_ENRICH)
def grey_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Web results enriched by batches of distinct addresses."""
    found = _enriched(spark, sf)
    out = found.select("occurrence_id", "url", "answer_document_type", "answer_language", "answer_status", "batch")
    out._scratch = found
    return out


_RAW = f"(select query_id, url, title, coalesce(abstract_or_snippet,'') content from records where {_GREY})"


@query(f"select coalesce(query_id,'') as query_id, coalesce(url,'') as url, concat_ws(',', case when coalesce(query_id,'')='' then 'query_id' end, case when coalesce(url,'')='' then 'url' end, case when coalesce(title,'')='' then 'title' end, case when length(content)>600 then 'content_length' end, case when regexp_matches(content,'[\\r\\n]') then 'content_lines' end) as faults from {_RAW} where coalesce(query_id,'')='' or coalesce(url,'')='' or coalesce(title,'')='' or length(content)>600 or regexp_matches(content,'[\\r\\n]')")
def grey_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Web results as delivered that lack a field, or whose text is too long or of several lines."""
    rows = table(spark, sf, "records", "system", "query_id", "url", "title", "abstract_or_snippet").where(F.upper(F.trim(F.regexp_replace(F.coalesce("system", F.lit("")), r"\s+", " "))) == "GREY LITERATURE")
    found = grey.row_faults(rows.withColumnRenamed("abstract_or_snippet", "content"))
    return found.select(F.coalesce("query_id", F.lit("")).alias("query_id"), F.coalesce("url", F.lit("")).alias("url"), "faults")


@query(f"""with g as (select query_id, url, title, {_sql(_CLEAN, 'abstract_or_snippet')}[1:600] c from records where {_GREY} and coalesce(url,'')<>''), f as (select count_if(coalesce(query_id,'')='' or coalesce(title,'')='') n from g)
select count_if(contains(query_id,'BROAD'))::bigint as broad_rows, count_if(not coalesce(contains(query_id,'BROAD'),false))::bigint as targeted_rows, count(*) as enriched_rows, count(distinct url) as unique_urls, (select n from f)::bigint as faults, true as counts_reconcile, (select n=0 from f) as rows_valid, count_if(contains(query_id,'BROAD'))>0 and count_if(not coalesce(contains(query_id,'BROAD'),false))>0 as both_phases_have_rows from g""")
def grey_qa(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and checks of both phases of the web search."""
    rows = _grey(spark, sf)
    broad = F.coalesce(F.col("query_id").contains("BROAD"), F.lit(False))
    found = _enriched(spark, sf)
    out = grey.grey_qa(rows.where(broad), rows.where(~broad), found)
    out._scratch = found
    return out


@query("select kind as name, sum(v)::double as total from (select 'prompt_tokens' kind, length(coalesce(text,'')) v from documents union all select 'completion_tokens', n_chars from documents) group by 1")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the numbers in usage maps; what is no number is left out."""
    rows = table(spark, sf, "documents", "text", "n_chars")
    return grey.usage(rows.select(F.create_map(F.lit("prompt_tokens"), F.length(F.coalesce("text", F.lit(""))).cast("string"), F.lit("completion_tokens"), F.col("n_chars").cast("string"), F.lit("model"), F.lit("x")).alias("usage")))


# --- sources ------------------------------------------------------------------------------------

@query("""select 'Semantic Scholar' as system, coalesce(query_id,'') as query_id, coalesce(paper_id,'') as source_record_id, coalesce(venue,'') as source_title, coalesce(publication_types,'') as document_type, case when coalesce(open_access_pdf_url,'')<>'' then 'OPEN_ACCESS_PDF' else 'NOT_IDENTIFIED' end as full_text_status, coalesce(open_access_pdf_url,'') as full_text_location,
concat_ws(' | ', nullif(paper_id,''), nullif(corpus_id::varchar,''), nullif(arxiv_id,''), nullif(pubmed_id::varchar,'')) as extra_identifiers from ss_mech_feeding_pumping_sponge_01""")
def scholar_records(spark: SparkSession, sf: str) -> DataFrame:
    """The sponge table as records of its source."""
    rows = files.records_of("Semantic Scholar", table(spark, sf, "ss_mech_feeding_pumping_sponge_01"))
    return rows.select("system", "query_id", "source_record_id", "source_title", "document_type", "full_text_status", "full_text_location", "extra_identifiers")


@query(f"""with m as (select {_bare('url')} u, max('documents/'||occurrence_id) loc from records where upper(trim(coalesce(full_text_status,'')))='ARCHIVED' and {_bare('url')}<>'' group by 1)
select occurrence_id, case when m.loc is not null then 'ARCHIVED' when lower(coalesce(language,''))='yes' then 'LIKELY_FULL_DOCUMENT_URL' else 'NOT_IDENTIFIED' end as full_text_status, coalesce(m.loc,'') as full_text_location from records left join m on m.u={_bare('records.url')} where {_GREY}""")
def manifest_status(spark: SparkSession, sf: str) -> DataFrame:
    """Web results against a manifest of archived documents (the records marked so), by address."""
    rows = table(spark, sf, "records", "occurrence_id", "system", "url", "full_text_status", "language")
    archived = rows.where(F.upper(F.trim(F.coalesce("full_text_status", F.lit("")))) == "ARCHIVED").select(F.col("occurrence_id").alias("filename"), _bare_address("url").alias("url")).where("url <> ''")
    by_url = archived.groupBy("url").agg(F.max(F.concat(F.lit("documents/"), "filename")).alias("location"))
    web = rows.where(F.upper(F.trim(F.regexp_replace(F.coalesce("system", F.lit("")), r"\s+", " "))) == "GREY LITERATURE").select("occurrence_id", _bare_address("url").alias("url"), "language")
    found = web.join(by_url, "url", "left")
    return found.select("occurrence_id", grey.grey_status(F.col("location"), F.col("language")).alias("full_text_status"), F.coalesce("location", F.lit("")).alias("full_text_location"))


@query("select source_file, count(*) as rows, count(distinct query_id) as queries from (select coalesce(source_file,'') source_file, query_id from records) group by 1")
def input_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every input file."""
    return table(spark, sf, "records", "source_file", "query_id").groupBy(F.coalesce("source_file", F.lit("")).alias("source_file")).agg(F.count("*").alias("rows"), F.countDistinct("query_id").alias("queries"))


@query("select occurrence_id, 'OCC'||lpad((row_number() over (order by system nulls first, source_file nulls first, occurrence_id))::varchar,6,'0') as load_id from records")
def load_order(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrence ids in load order: by source, file and place, without a global window."""
    rows = table(spark, sf, "records", "occurrence_id", "system", "source_file").withColumnRenamed("occurrence_id", "own")
    placed = files.occurrence_ids(rows, [F.col("system").asc_nulls_first(), F.col("source_file").asc_nulls_first(), F.col("own").asc()])
    return placed.select(F.col("own").alias("occurrence_id"), F.col("occurrence_id").alias("load_id"))


# --- functions, searches and checks -------------------------------------------------------------

_FIRST = "trim(string_split_regex(coalesce(authors,''),'[|;]')[1])"


@query(f"""select occurrence_id, {_bare('url')} as bare_form, {_STRIP('doi')} as doi_form, regexp_extract(regexp_replace(coalesce(url,''),'/+$',''),'([^/]*)$',1) as short_id, array_to_string(string_split({_sql(_CLEAN, 'title')},' ')[1:20],' ') as first_words,
array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(extra_identifiers,''),'W\\d+'))),' | ') as work_ids, {_sql(_DOI, 'url')} as url_doi, array_to_string(list_sort(list_distinct(list_filter([{_sql(_CLEAN, 'family')},{_sql(_CLEAN, 'system')},{_sql(_CLEAN, 'query_id')}], lambda x: x<>''))),' | ') as joined from records""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Identifier and text functions over the records."""
    rows = table(spark, sf, "records", "occurrence_id", "url", "doi", "title", "extra_identifiers", "family", "system", "query_id")
    return rows.select(
        "occurrence_id", _bare_address("url").alias("bare_form"), X.strip_doi(F.col("doi")).alias("doi_form"), X.short_id(F.col("url")).alias("short_id"), X.first_words(F.col("title")).alias("first_words"), F.array_join(X.work_ids(F.col("extra_identifiers")), " | ").alias("work_ids"),
        X.normalize_doi(F.col("url")).alias("url_doi"), X.join_unique(F.array("family", "system", "query_id")).alias("joined"),
    )


@query()
def author_keys(spark: SparkSession, sf: str) -> DataFrame:
    """First author's surname, DOI of an escaped address, and the title in a reference made of each record."""
    rows = table(spark, sf, "records", "occurrence_id", "authors", "url", "title", "year")
    cited = F.concat(F.coalesce("authors", F.lit("")), F.lit(" ("), F.coalesce("year", F.lit("n.d.")), F.lit("). "), F.coalesce("title", F.lit("")), F.lit(". Journal."))
    return rows.select("occurrence_id", X.first_author(F.col("authors")).alias("author1"), X.doi_from_url(F.col("url")).alias("doi"), X.cited_title(cited).alias("cited"))


def _term(term) -> str:  # noqa: ANN001
    if isinstance(term, tuple):
        return "(" + " and ".join(_group(g) for g in term) + ")"
    return rf"regexp_matches(t,'(^|[^\pL\pN])(?:{_words(term)})($|[^\pL\pN])')"


def _words(term: str) -> str:
    words = [w for w in re.split(r"[^A-Za-z0-9*]+", term.lower()) if w]
    return r"[^\pL\pN]+".join(w.replace("*", r"[\pL\pN]*") for w in words)


def _group(terms: tuple) -> str:
    return "(" + " or ".join(_term(t) for t in terms) + ")"


def _family_sql(family: str) -> str:
    groups = search.FAMILIES[family]
    if family != search.NEAR_FAMILY:
        return " and ".join(_group(g) for g in groups)
    a, b = ("(?:" + "|".join(_words(t) for t in g) + ")" for g in groups[1:])
    gap = rf"[^\pL\pN]+(?:[\pL\pN]+[^\pL\pN]+){{0,{search.NEAR_WORDS - 1}}}"
    return f"{_group(groups[0])} and (" + " or ".join(rf"regexp_matches(t,'(^|[^\pL\pN]){x}{gap}{y}($|[^\pL\pN])')" for x, y in ((a, b), (b, a))) + ")"


@query("select doc_id, " + ", ".join(f"{_family_sql(f)} as {f.lower()}" for f in search.FAMILIES) + " from (select doc_id, lower(coalesce(text,'')) t from documents)")
def family_search(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the eight families a document matches, in the first dialect."""
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", *[search.matches(search.family_query(f), F.col("text")).alias(f.lower()) for f in search.FAMILIES])


_SPONGE = search.FAMILIES["MECH_FEEDING_PUMPING_SPONGE"]


@query(rf"select occurrence_id, ({' and '.join(_group(g) for g in _SPONGE)}) as family, ({_term('sponge*')} or {_term('coral*')}) and regexp_matches(lower(regexp_replace(coalesce(url,''),'[?#].*$','')),'\.pdf$') as papers, ({_term('coral*')}) and regexp_matches(h,'(^|\.)reefdata\.example$') as domain from (select occurrence_id, url, lower(coalesce(title,'')||' '||coalesce(abstract_or_snippet,'')) t, regexp_extract(lower(coalesce(url,'')),'^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)',1) h from records)")
def web_search(spark: SparkSession, sf: str) -> DataFrame:
    """A family in the web dialect, a file type and a domain."""
    rows = table(spark, sf, "records", "occurrence_id", "title", "abstract_or_snippet", "url")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract_or_snippet", F.lit("")))
    on = lambda q, domains=(): search.on_web(q, text, F.col("url"), domains)
    return rows.select("occurrence_id", on(search.family_query("MECH_FEEDING_PUMPING_SPONGE", "web")).alias("family"), on("(sponge* OR coral*) filetype:pdf").alias("papers"), on("coral*", ("reefdata.example",)).alias("domain"))


@query("select doc_id, coalesce(source,'') as source from documents where coalesce(source,'') not in (select source from mix_targets where source is not null)")
def unknown_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose source is not in the vocabulary of targets."""
    rows = table(spark, sf, "documents", "doc_id", "source").withColumn("source", F.coalesce("source", F.lit("")))
    return export.unknown_codes(rows, table(spark, sf, "mix_targets", "source"), ["source"])


_JUDGED = f"""select doc_id, 'CWC-'||upper(sha1('doc:'||doc_id)[1:12]) corpus_id, [{','.join(f"'{d}'" for d in export.DECISIONS)}][doc_id%4+1] decision, case when doc_id%5=0 then null else [{','.join(f"'{r}'" for r in export.REASONS)}][doc_id%14+1] end reason_code, coalesce(text,'')[1:240+doc_id%3] organism_evidence, coalesce(lang,'') stressor_evidence, source response_evidence,
case when doc_id%2=0 then null else coalesce(text,'') end transferability_basis, [{','.join(f"'{s}'" for s in export.SOURCES)}][doc_id%4+1] screening_source, ['HIGH','MEDIUM','LOW'][doc_id%3+1] confidence, case when doc_id%7=0 then null else doc_id%2=0 end needs_full_text, coalesce(lang,'') rationale, [{','.join(f"'{d}'" for d in export.DECISIONS)}][(doc_id//3)%4+1] truth from documents"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up judgements of the documents, by arithmetic on their ids."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    return table(spark, sf, "documents", "doc_id", "text", "lang", "source").select(
        "doc_id", F.concat(F.lit("CWC-"), F.upper(F.substring(F.sha1(F.concat(F.lit("doc:"), i.cast("string"))), 1, 12))).alias("corpus_id"), pick(export.DECISIONS, i % 4).alias("decision"), F.when(i % 5 != 0, pick(export.REASONS, i % 14)).alias("reason_code"), text.substr(F.lit(1), (240 + i % 3).cast("int")).alias("organism_evidence"),
        F.coalesce("lang", F.lit("")).alias("stressor_evidence"), F.col("source").alias("response_evidence"), F.when(i % 2 != 0, text).alias("transferability_basis"), pick(export.SOURCES, i % 4).alias("screening_source"), pick(export.CONFIDENCE, i % 3).alias("confidence"), F.when(i % 7 != 0, i % 2 == 0).alias("needs_full_text"),
        F.coalesce("lang", F.lit("")).alias("rationale"), pick(export.DECISIONS, F.floor(i / 3) % 4).alias("truth"),
    )


def _in(values: tuple[str, ...]) -> str:
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


_BROKEN = {
    "corpus_id": "not regexp_matches(corpus_id,'^CWC-[A-F0-9]{12}$')", "decision": f"decision not in {_in(export.DECISIONS)}", "reason_code": f"reason_code is not null and reason_code not in {_in(export.REASONS)}", "screening_source": f"screening_source not in {_in(export.SOURCES)}", "confidence": f"confidence not in {_in(export.CONFIDENCE)}", "needs_full_text": "needs_full_text is null",
    **{n: (f"length({n})>{m}" if n == "transferability_basis" else f"coalesce(length({n})>{m},true)" + (f" or length({n})<1" if n == "rationale" else "")) for n, m in export.LENGTHS.items()},
    "exclude_reason": "decision='EXCLUDE' and coalesce(not starts_with(reason_code,'X'),true)", "uncertain_reason": "decision='UNCERTAIN' and coalesce(not starts_with(reason_code,'U'),true)", "low_is_uncertain": "confidence='LOW' and decision<>'UNCERTAIN'",
}


@query(f"with j as ({_JUDGED}) select doc_id, concat_ws(',', " + ", ".join(f"case when {rule} then '{name}' end" for name, rule in _BROKEN.items()) + ") as broken from j")
def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of a screening judgement that a row breaks."""
    return _judged(spark, sf).select("doc_id", F.array_join(export.violations(export.screening_rules()), ",").alias("broken"))


_T, _F = "truth='CORE_INCLUDE'", "decision='CORE_INCLUDE'"
_J = "sum(case when {0} then 1 else 0 end)"


@query(f"""with j as ({_JUDGED}), c as (select {_J.format(f'{_T} and {_F}')} tp, {_J.format(f'not {_T} and {_F}')} fp, {_J.format(f'{_T} and not {_F}')} fn, {_J.format(f'not {_T} and not {_F}')} tn from j)
select tp::bigint tp, fp::bigint fp, fn::bigint fn, tn::bigint tn, round(tp/(tp+fn),6) recall, round(tp/(tp+fp),6) "precision", round(tn/(tn+fp),6) specificity, round(tn/(tn+fn),6) npv, round((tp+tn)/(tp+fp+fn+tn),6) agreement from c""")
def screening_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and rates of core inclusion against the truth."""
    return export.agreement(_judged(spark, sf), F.col("truth") == "CORE_INCLUDE", F.col("decision") == "CORE_INCLUDE")


@query(f"with j as ({_JUDGED}) select truth, decision as found, count(*) as rows from j group by 1,2")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return export.confusion(_judged(spark, sf), "truth", "decision")


@query(f"""with j as ({_JUDGED}), k as (select truth in ('CORE_INCLUDE') c, decision in ('CORE_INCLUDE') d, truth in ('CORE_INCLUDE','TRANSFERABLE_MECHANISM') e, decision in ('CORE_INCLUDE','TRANSFERABLE_MECHANISM') f from j)
select round(count_if(c and d)/count_if(c),6) as core_recall, round(count_if(e and f)/count_if(e),6) as combined_recall from k""")
def screening_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of core records, and of core and transferable ones together."""
    rows = _judged(spark, sf)
    both = export.DECISIONS[:2]
    return rows.agg(export.recall_of(rows, "truth", "decision", both[:1]).alias("core_recall"), export.recall_of(rows, "truth", "decision", both).alias("combined_recall"))
