import difflib
import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewrack.functions import text as X
from tidewrack.operators import export, graph, recovery, resolution, sampling, search
from tidewrack.plans import pipeline, reference  # noqa: F401  pipeline registers its queries
from tidewrack.sources import files

SQL = sorted(reference.SQL)


def plain(rows, columns):
    show = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", SQL)
def test_sql_agrees(spark, data, name):
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for t in ("records", "documents", "benchmark_validation_blinded", "grey_institutional_targets", "lineitem", "part", "orders", "events", "ss_mech_feeding_pumping_sponge_01", "mix_targets"):
        db.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = db.execute(reference.SQL[name]).df()
    got = reference.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([r.asDict() for r in got.collect()], got.columns) == plain(want.astype(object).where(want.notna(), None).to_dict("records"), got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, column, *values, **named):
    return spark.range(1).select(column(*[F.lit(v) for v in values], **named).alias("x")).first().x


def test_identifiers(spark):
    assert one(spark, X.normalize_doi, " https://doi.org/10.1000/ABC.1). ") == "10.1000/abc.1"
    assert one(spark, X.normalize_doi, "10.1000%2Fa+b") == "10.1000/a"
    assert one(spark, X.strip_doi, "doi.org/Anything.") == "anything"
    assert one(spark, X.normalize_title, "The Éffects & ﬁne—Silt") == "effects and finesilt"
    assert one(spark, X.normalize_title, "The Reef", article=False) == "the reef"
    assert one(spark, X.normalize_url, "HTTP://A.example//b/?utm_source=x&q=a%20b#c") == "http://a.example/b?q=a+b"
    assert one(spark, X.normalize_url, "https://A.example:80//b//") == "https://a.example:80/b"
    assert one(spark, X.url_domain, "https://www.A.example:8080/x") == "a.example:8080"
    assert one(spark, X.first_author, "de Roe, Ann | Doe B") == "de roe"
    assert one(spark, X.normalize_year, "in 1999 or 2001") == "1999"
    assert one(spark, X.recovery_url, "https://doi.org/none//?utm_source=x&b=1#c") == "https://doi.org/none?b=1"
    assert one(spark, X.normalize_url, "https://doi.org/none//?utm_source=x") == "https://doi.org/none//?utm_source=x"
    assert one(spark, X.recovery_url, "a.example//b/?ref=1") == "a.example/b" and one(spark, X.normalize_url, "a.example//b/?ref=1/") == "a.example//b/?ref=1"
    assert one(spark, X.bare_url, "HTTPS://A.Example/B//C/?q#f") == "https://a.example/B//C"
    assert one(spark, X.normalize_doi, "10.1000%2Fa%zz") == "10.1000/a"
    assert one(spark, X.doi_from_url, "https://x.example/10.1000%252Fab") == "10.1000/ab"
    assert one(spark, X.short_id, "https://x.example/W12/") == "W12" and one(spark, X.first_words, " a  b c ", n=2) == "a b"
    assert one(spark, X.work_ids, "W2 | x/W1 W2") == ["W1", "W2"]
    assert one(spark, X.cited_title, "Roe, A. (2010). Fine silt: a study. J Reef 2.") == "Fine silt: a study"
    assert one(spark, X.clean_space, None) == ""


def test_sequence_ratio_is_not_symmetric(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("abcd " * 60, "bcda " * 60), (None, "")], "a string, b string")
    got = [r.x for r in rows.select(X.sequence_ratio("a", "b").alias("x")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in (("tide", "diet"), ("diet", "tide"), ("abcd " * 60, "bcda " * 60), ("", ""))]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.component for r in graph.smallest_members(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}


def test_exact_clusters_follow_the_anchor(spark):
    rows = [(0, "", "2000", "a long enough title"), (1, "d1", "2001", "a long enough title"), (2, "", "2005", "a long enough title"), (3, "d2", "2000", "a long enough title"), (4, "d1", "1990", "other"), (5, "", "", "short")]
    got = {r.occ_idx: r.cluster for r in resolution.exact_clusters(spark.createDataFrame(rows, "occ_idx long, doi string, year string, norm_title string")).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 1, 5: 5}


def test_url_pass_refuses_unlike_dois(spark):
    rows = [(0, "d1", "u"), (1, "", "u"), (2, "d2", "u"), (3, "", "v")]
    df = spark.createDataFrame(rows, "occ_idx long, doi string, canonical_url string")
    clusters = df.select("occ_idx", F.col("occ_idx").alias("cluster"))
    got = {r.cluster: r.joined for r in resolution.url_clusters(df, clusters).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_search(spark):
    text = F.lit("Cold-water corals after fine dredge spoil, no recovery")
    row = spark.range(1).select(
        search.matches('coral* AND "dredge spoil"', text).alias("a"), search.matches("coral AND spoil", text).alias("b"), search.matches("corals NEAR/2 fine", text).alias("c"), search.matches("corals NEAR/1 spoil", text).alias("d"),
        search.matches("(sponge | coral) + recover", text, stemmed=True).alias("e"), search.matches("corals NOT recovery", text).alias("f"), search.matches("TS=(", text).alias("g"), search.matches("x", F.lit(None).cast("string")).alias("h"),
    ).first()
    assert list(row) == [True, False, True, False, True, False, True, False]


def test_sampling_against_the_sequential_loop(spark):
    import hashlib

    rng = random.Random(3)
    rows = [(f"k{i}", rng.choice("abc"), False) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, level string, taken boolean")
    got = {r.k for r in sampling.round_robin(sampling.ensure_levels(df, "level", 3, "S", "k"), ["level"], 20, "S", "k").where("taken").collect()}
    h = lambda *p: hashlib.sha256("|".join(p).encode()).hexdigest()
    taken = []
    for level in "abc":
        taken += sorted((k for k, v, _ in rows if v == level), key=lambda k: h("S", "ensure", "level", level, k))[:3]
    lines = {v: sorted((k for k, w, _ in rows if w == v and k not in taken), key=lambda k: h("S", "bucket", v, k)) for v in "abc"}
    while len(taken) < 20:
        for v in sorted(lines, key=lambda v: h("S", v)):
            if lines[v] and len(taken) < 20:
                taken.append(lines[v].pop(0))
    assert got == set(taken)


def test_near_counts_between_whole_phrases(spark):
    found = lambda q, t: one(spark, lambda: search.matches(q, F.lit(t)))
    assert not found('"sea pen*" NEAR/10 recovery', "the sea was calm during recovery")
    assert found('"sea pen*" NEAR/3 recovery', "sea pens made a recovery") and not found('"sea pen*" NEAR/2 recovery', "sea pens made a recovery")
    assert not found("(coral AND tailings) NEAR/10 recovery", "recovery of coral") and found("(coral AND tailings) NEAR/10 recovery", "recovery of coral from tailings")
    assert found("(coral OR tailings) NEAR/1 recovery", "recovery, tailings") and not found("(coral NOT tailings) NEAR/9 recovery", "coral recovery tailings")
    assert found("(a NEAR/2 b) NEAR/1 c", "a x b c") and not found("(a NEAR/1 b) NEAR/1 c", "a x b c")
    assert found("Überschüttung* NEAR/2 korallen", "Überschüttungen von Korallen") and not found("ber", "über")


def test_web_dialect(spark):
    on = lambda q, u, *d: one(spark, lambda: search.on_web(q, F.lit("coral plumes"), F.lit(u), d))
    assert on("coral filetype:pdf", "https://a.example/x.PDF?y") and not on("coral filetype:pdf", "https://a.example/x")
    assert on("coral", "https://b.a.example:80/x", "a.example") and not on("coral", "https://ba.example/x", "a.example")
    for family in search.FAMILIES:
        for dialect in ("wos", "scholar", "stemmed", "web"):
            assert search.terms(search.parse(search.family_query(family, dialect)))


def test_recovery(spark):
    known = spark.createDataFrame([("b1", "10.1/x", "", "fine silt", ""), ("b2", "", "", "no such thing", ""), ("b3", "", "", "", "old name"), ("b4", "", "u1", "", "")], "known_id string, doi string, url string, norm_title string, alias_title string")
    corpus = spark.createDataFrame([("c1", "10.1/x", ["u9"], "other", "q1"), ("c2", "", ["u0", "u1"], "fine silt", "q1 | q2"), ("c3", "10.1/x", [], "fine silt", ""), ("c4", "", [], "old name", "fix")], "corpus_id string, doi string, url array<string>, norm_title string, query_ids string")
    best = {r.known_id: (r.corpus_id, r.score, r.basis) for r in recovery.best_match(recovery.exact_evidence(known, corpus)).collect()}
    assert best == {"b1": ("c1", 100, "DOI"), "b3": ("c4", 80, "RESOLVED_ALIAS_TITLE"), "b4": ("c2", 95, "CANONICAL_URL")}
    status = recovery.recovery_status(known, corpus, {"b3": {"fix"}})
    assert {r.known_id: (r.recovery_status, r.independently_recovered) for r in status.collect()} == {"b1": ("RECOVERED", True), "b2": ("NOT_RECOVERED", False), "b3": ("RECOVERED_AFTER_REMEDIATION", False), "b4": ("RECOVERED", True)}
    kinds = known.select("known_id", F.lit("CORE").alias("kind"))
    told = recovery.diagnostics(status, recovery.nearest_title(known, corpus), kinds, "CORE").collect()
    near = max(("other", "fine silt", "old name"), key=lambda t: difflib.SequenceMatcher(None, "no such thing", t).ratio())
    assert [(r.known_id, r.closest_corpus_id) for r in told] == [("b2", {"other": "c1", "fine silt": "c2", "old name": "c4"}[near])]
    assert recovery.recovery_counts(status, kinds).first().accounted == 3


def test_nearest_title_is_the_nearest(spark, monkeypatch):
    rng = random.Random(8)
    title = lambda: " ".join("".join(rng.choice("abcdeo") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(1, 6)))
    asked = [("k0", "sedimentations upon octocorals"), *((f"k{i}", title()) for i in range(1, 12))]
    held = [("c0", "upon reading"), ("c1", "sedimentation on octocoral"), *((f"c{i:03d}", title()) for i in range(2, 150)), ("c999", "")]
    known, corpus = (spark.createDataFrame(r, f"{n} string, norm_title string") for r, n in ((asked, "known_id"), (held, "corpus_id")))
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {k: min((-ratio(t, u), c) for c, u in held if u and ratio(t, u)) for k, t in asked}
    for block in (10_000, 3):
        monkeypatch.setattr(recovery, "KNOWN_BLOCK", block)
        got = {r.known_id: (-r.similarity, r.corpus_id) for r in recovery.nearest_title(known, corpus).collect()}
        assert got == want
    assert want["k0"][1] == "c1"
    assert recovery.nearest_title(known.limit(0), corpus).count() == 0 and recovery.nearest_title(known, corpus.limit(0)).count() == 0


def test_best_line(spark):
    pages = spark.createDataFrame([(1, "# Menu\n\n## *Fine silt* on reefs\nother", "https://x.usgs.example/a"), (2, None, None), (3, "fine", "https://b.example/")], "page_id int, content string, url string")
    rows = {r.page_id: (r.line, r.validated) for r in recovery.best_line(pages, "fine silt", "usgs.example").collect()}
    assert rows == {1: ("Fine silt  on reefs", True), 3: ("fine", False)}


def test_calibration_against_the_sequential_loop(spark):
    import hashlib

    from tidewrack.operators import calibration

    rng = random.Random(5)
    rows = [(f"c{i:04d}", rng.choice(["OpenAlex", "OpenAlex | Semantic Scholar", "Grey literature", " Web of Science"]), rng.choice([*calibration.FAMILY_ORDER[:3], "x", ""]), rng.choice(["corals", "sediment", "coral burial", ""]), rng.choice(["", "text " * rng.randrange(1, 300)]), rng.choice(["NOT_IDENTIFIED", "ARCHIVED"]), rng.choice(["article", "book", None, " "])) for i in range(700)]
    df = calibration.prepare(spark.createDataFrame(rows, "corpus_id string, discovery_systems string, families string, title string, abstract_or_snippet string, full_text_status string, document_type string"), "S")
    fields = [r.asDict() for r in df.collect()]
    digest = lambda *p: hashlib.sha256("|".join(p).encode()).hexdigest()
    taken = {}
    kinds = {}
    for r in fields:
        kinds[r["document_type_stratum"]] = kinds.get(r["document_type_stratum"], 0) + 1
    common = sorted(kinds, key=lambda k: (-kinds[k], k))[:12]
    for field, minimum in calibration.PASSES:
        allowed = calibration.FAMILY_ORDER if field == "primary_family" else common if field == "document_type_stratum" else {r[field] for r in fields}
        for level in sorted(allowed):
            have = sum(r[field] == level for r in taken.values())
            for r in sorted((r for r in fields if r[field] == level), key=lambda r: digest("S", "ensure", field, level, r["corpus_id"])):
                if have < minimum and r["corpus_id"] not in taken:
                    taken[r["corpus_id"]], have = r, have + 1
    lines = {}
    for r in fields:
        lines.setdefault("|".join(r[f] for f in calibration.BUCKET), []).append(r)
    lines = {k: sorted((r for r in v if r["corpus_id"] not in taken), key=lambda r: digest("S", "bucket", k, r["corpus_id"])) for k, v in lines.items()}
    while len(taken) < 400:
        for k in sorted(lines, key=lambda k: digest("S", k)):
            if lines[k] and len(taken) < 400:
                r = lines[k].pop(0)
                taken[r["corpus_id"]] = r
    got = calibration.select(df, "S").collect()
    assert {r.corpus_id for r in got} == set(taken) and len(got) == 400
    order = sorted(taken, key=lambda i: digest("S", "final-sample", i))
    assert {r.corpus_id: r.calibration_record_id for r in got} == {c: f"CAL-{i:04d}" for i, c in enumerate(order, 1)}
    assert sum(r.split == "VALIDATION" for r in got) == 100 and all(len(r.screening_text) <= 1200 and r.text_truncated == (len((r.abstract_or_snippet or "").strip()) > 1200) for r in got)


def test_tagged_files(spark, tmp_path):
    text = "﻿TY  - JOUR\nAU  - Roe, A\nAU  - Doe, B\nTI  - Fine\n  silt\nTotal Cites: 3\nTY  - RPRT\nTI  - Two\nER  - \nTI  - tail"
    (tmp_path / "WOS_SED_DRILLING_01.ris").write_text(text)
    rows = files.ris_occurrences(files.read_ris(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert [(r.title, r.authors, r.family) for r in rows] == [("Fine silt", "Roe, A | Doe, B", "SED_DRILLING"), ("Two", "", "SED_DRILLING"), ("tail", "", "SED_DRILLING")]
    (tmp_path / "t.csv").write_text('a,b\n"x ""q""\ny",\n')
    row = files.read_table(spark, str(tmp_path / "t.csv"), ["a", "b", "c"]).first()
    assert tuple(row) == ('x "q"\ny', "", "")
    assert files.read_optional(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0


def test_occurrence_ids(spark):
    got = files.occurrence_ids(spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "v int"), ["v"]).collect()
    assert {r.v: r.occ_idx for r in got} == {i: i for i in range(50)}


def test_export(spark):
    fields = {"id": F.lit("C1"), "title": F.lit(""), "authors": F.lit("A | B"), "document_type": F.lit("Conference paper"), "year": F.lit(None).cast("string")}
    assert one(spark, lambda: export.ris_text(fields, "db", "/")) == "TY  - CPAPER/TI  - [Untitled record C1]/AU  - A/AU  - B/AN  - C1/DB  - db/N1  - corpus_id=C1/N1  - full_text_status=/ER  -"
    assert one(spark, lambda: export.leaks(F.lit("A Secret"), ("secret", "x"))) == ["secret"]


def test_streams(spark, tmp_path):
    from tidewrack.streaming import upserts

    schema = "query_id string, v int, loaded_at int"
    add = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: upserts.stream_upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    held = lambda: {r.query_id: r.v for r in upserts.current_table(spark, str(tmp_path / "out")).collect()}
    with pytest.raises(ValueError):
        held()
    add(("a", 1, 1), ("b", 1, 4), ("a", 2, 2), (None, 9, 9))
    run()
    assert held() == {"a": 2, "b": 1}
    add(("b", 5, 3), ("c", 1, None))
    run()
    assert held() == {"a": 2, "b": 1, "c": 1}  # the late row is older than the stored one
    point = upserts._point
    upserts._point = lambda *a: 1 / 0
    try:
        add(("a", 7, 7))
        with pytest.raises(Exception):
            run()
        assert held() == {"a": 2, "b": 1, "c": 1}  # the batch was lost, the table was not
    finally:
        upserts._point = point
    run()
    assert held() == {"a": 7, "b": 1, "c": 1}


def test_pages(spark, tmp_path):
    import json

    from tidewrack.sources import pages

    put = lambda name, page: (tmp_path / name).write_text(json.dumps(page))
    put("a1.json", {"meta": {"count": 3}, "results": [{"id": "W1", "title": "x"}, {"id": "W2"}]})
    put("a2.json", {"meta": {"count": 3}, "results": [{"id": "W3"}]})
    put("a3.json", {"meta": {"count": 3}, "results": []})
    got = pages.checked(pages.read_pages(spark, str(tmp_path / "a*.json")))
    assert sorted((r.id, r.result_rank) for r in got.collect()) == [("W1", 1), ("W2", 2), ("W3", 1)]
    put("a4.json", {"meta": {"count": 3}, "results": [{"id": "W3"}]})
    with pytest.raises(ValueError, match="1 ids repeated"):
        pages.checked(pages.read_pages(spark, str(tmp_path / "a*.json")))
    put("s1.json", {"total": 1, "token": "t", "data": [{"paperId": "p"}]})
    assert tuple(pages.read_pages(spark, str(tmp_path / "s*.json"), "paperId").select("id", "token", "reported").first()) == ("p", "t", 1)


def test_flatteners(spark):
    import json

    read = lambda schema, *rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").select(F.from_json("v", schema).alias("w")).select("w.*")
    work = {"id": "https://x.example/W1", "doi": None, "title": "T", "publication_year": 2001, "authorships": [{"author": {"id": "A1", "display_name": "Roe"}}, {"author": {"id": None, "display_name": None}}, {"author": None}], "primary_location": {"landing_page_url": "", "source": {"display_name": "J"}}, "open_access": {"is_oa": True}, "abstract_inverted_index": {"silt": [1], "Fine": [0, 2]}, "topics": [{"display_name": "a"}, {"display_name": None}], "referenced_works": ["https://x.example/W2"]}
    row = files.flatten_work(read(files.WORK, work, {"id": "W9"})).orderBy("openalex_id").collect()
    assert (row[1].authors, row[1].author_openalex_ids, row[1].topics, row[1].abstract, row[1].cited_by_count, row[1].is_oa) == ("Roe |  | ", "A1 |  | ", "a | ", "Fine silt Fine", 0, "true")
    assert (row[0].title, row[0].publication_year, row[0].abstract, row[0].referenced_works) == ("", "", "", "") and len(row[0]) == 20
    chained = files.chained_work(read(files.WORK, work)).first()
    assert (chained.work_id, chained.authors, chained.landing_page_url, chained.referenced_works) == ("W1", "Roe", "https://x.example/W1", ["W2"])
    paper = {"paperId": "p", "externalIds": {"DOI": "10.1/x"}, "authors": [{"name": "Roe"}, {}], "publicationTypes": ["Review", "JournalArticle"], "openAccessPdf": None, "s2FieldsOfStudy": [{"category": "Biology"}], "isOpenAccess": False}
    flat = files.flatten_paper(read(files.PAPER, paper)).first()
    assert (flat.doi, flat.authors, flat.publication_types, flat.open_access_pdf_url, flat.s2_fields_of_study, flat.is_open_access) == ("10.1/x", "Roe; ", "Review; JournalArticle", "", "Biology", "false") and len(flat) == 20


def test_six_sources(spark):
    make = lambda **c: spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} string" for k in c))
    got = {s: files.records_of(s, r, a).first() for s, r, a in (
        ("Web of Science", make(query_id="q", doi="10.1000/x", url="", source_record_id="WOS:1", title="t"), None),
        ("OpenAlex", make(openalex_id="W1", doi="d", landing_page_url="", is_oa="True", retrieved_at_utc="2026-08-13T01", primary_source_openalex_id="S1", publication_year="2001"), None),
        ("Semantic Scholar", make(paper_id="p", corpus_id="", arxiv_id="a", pubmed_id="", open_access_pdf_url="u.pdf", venue="v"), None),
        ("Citation chaining", make(query_ids="OA_CHAIN_G1_X", work_id="W2", parent_work_ids="W1", parent_corpus_ids="", full_text_status="OPEN_ACCESS_PDF"), None),
        ("Benchmark remediation", make(url="u", benchmark_id="B5", remediation_basis="EXACT_URL", date_searched="d"), None),
        ("Grey literature", make(url="https://a.example/x/", answer_full_document_guess="no", answer_publication_year="", published_date="2003", answer_issuing_organization="o", answer_document_type="t", answer_language="en", content="c", date_searched="d", target_id="T"), make(url="https://a.example/x", location="documents/f")),
    )}
    assert got["Web of Science"].url == "https://doi.org/10.1000/x" and got["Web of Science"].full_text_status == "NOT_IDENTIFIED"
    assert (got["OpenAlex"].url, got["OpenAlex"].full_text_status, got["OpenAlex"].extra_identifiers, got["OpenAlex"].retrieved_date) == ("d", "OPEN_ACCESS_LANDING_PAGE", "W1 | S1", "2026-08-13")
    assert (got["Semantic Scholar"].full_text_status, got["Semantic Scholar"].extra_identifiers) == ("OPEN_ACCESS_PDF", "p | a")
    assert (got["Citation chaining"].full_text_status, got["Citation chaining"].extra_identifiers) == ("OPEN_ACCESS_PDF", "W2 | W1")
    assert got["Benchmark remediation"].extra_identifiers == "B5 | EXACT_URL | INITIAL_INDEPENDENT_RECOVERY_FALSE"
    assert (got["Grey literature"].full_text_status, got["Grey literature"].full_text_location, got["Grey literature"].year) == ("ARCHIVED", "documents/f", "2003")
    assert len({tuple(r.__fields__) for r in got.values()}) == 1 and [got[s].source_rank for s in files.SYSTEMS] == list(range(6))
    by_url, by_query = files.document_manifest(spark.createDataFrame([("f1", "https://a.example/x/", "q1 | q2"), ("f2", "https://a.example/x", "q2")], "filename string, source_url string, discovery_query_ids string"))
    assert [tuple(r) for r in by_url.collect()] == [("https://a.example/x", "documents/f2")]
    assert {r.query_id: r.locations for r in by_query.collect()} == {"q1": ["documents/f1"], "q2": ["documents/f1", "documents/f2"]}


def test_tables_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "q"\ny'), ("b", None)], "k string, v string")
    files.write_table(rows, str(tmp_path / "csv"), single=True)
    assert {tuple(r) for r in files.read_table(spark, str(tmp_path / "csv")).collect()} == {("a", 'x "q"\ny'), ("b", "")}
    for n in (1, 2):
        files.replace_table(spark.range(n), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    built = []
    seeds = spark.createDataFrame([("W1",), ("W2",)], "work_id string")
    make = lambda: built.append(1) or spark.range(3)
    for s in (seeds, seeds.orderBy(F.desc("work_id")), seeds.limit(1)):
        assert files.seeded_edges(s, str(tmp_path / "e"), make).count() == 3
    assert len(built) == 2
    files.drop_edges(spark, str(tmp_path / "e"))
    assert not (tmp_path / "e").exists()
    (tmp_path / "f.bin").write_bytes(b"x")
    assert files.file_digests(spark, str(tmp_path / "f.bin")).first().length == 1


def test_no_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tidewrack.session import shared_folder

    conf = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k: None), master="spark://a:7077", applicationId="x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=conf))


def test_similar_pairs_lose_no_mergeable_pair(spark):
    rng = random.Random(9)
    rows = []
    for i in range(70):
        words = ["effects", "of", *(rng.choice("silt mud clay sand dust") + str(rng.randrange(2)) for _ in range(rng.randrange(4, 8)))]
        rows.append((i, " ".join(words), "2000", rng.choice(["roe", "doe", ""]), ""))
    titles = spark.createDataFrame(rows, "occ_idx long, norm_title string, year string, author1 string, doi string")
    key = lambda df: {(r.l_occ_idx, r.r_occ_idx, r.decision) for r in df.where("jaccard >= 0.8").collect()}
    every = resolution.similar_pairs(titles, every=True)
    assert key(resolution.similar_pairs(titles)) == key(every)
    want = set()
    for i, a, *_ in rows:
        for j, b, *_ in rows:
            x, y = set(a.split()), set(b.split())
            if i < j and min(len(a), len(b)) >= 20 and len(x & y) / len(x | y) >= 0.8 and " ".join(a.split()[:2]) == " ".join(b.split()[:2]):
                want.add((i, j))
    assert {(a, b) for a, b, _ in key(every)} == want


def sequential(rows):
    """The similar-title pass as a loop: rows of (first, occ_idx, p, l, norm_title, year, author1, doi); reviews and the cluster of each."""
    root, group, best, doi = {r[0]: r[0] for r in rows}, {r[0]: [r] for r in rows}, {r[0]: r for r in rows}, {r[0]: r[7] for r in rows}
    blocks, seen = {}, []
    for r in sorted(rows):
        if len(r[4]) >= 20:
            blocks.setdefault(" ".join(r[4].split()[:2])[:28], []).append(r[0])
    for b in blocks.values():
        for i, x in enumerate(b):
            for y in b[i + 1 :]:
                p, q = root[x], root[y]
                if p == q:
                    continue
                u, v = best[p], best[q]
                ratio, s, t = difflib.SequenceMatcher(None, u[4], v[4]).ratio(), set(u[4].split()), set(v[4].split())
                jaccard = len(s & t) / len(s | t)
                if ratio < 0.88 and jaccard < 0.80:
                    continue
                same, none = u[6] == v[6] != "", not u[6] or not v[6]
                free = not (doi[p] and doi[q] and doi[p] != doi[q]) and (not u[5] or not v[5] or abs(int(u[5]) - int(v[5])) <= 1)
                merge = free and (same and ratio >= 0.965 and jaccard >= 0.88 or (same or none) and ratio >= 0.985 and jaccard >= 0.94)
                seen.append((u[1], v[1], "MERGE" if merge else "KEEP_SEPARATE"))
                if merge:
                    for m in group[q]:
                        root[m[0]] = p
                    group[p] += group.pop(q)
                    best[p], doi[p] = max(u, v, key=lambda r: (r[2], r[3], -r[1])), doi[p] or doi[q]
    return sorted(seen), root


def similar_rows():
    rng = random.Random(4)
    words = ["effects", "of", "fine", "sediment", "burial", "on", "cold", "water", "corals", "and", "sponges", "in", "the", "northern", "fjords", "after", "dredging", "works"]
    rows = []
    for i in range(90):
        w = list(words)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            k = rng.randrange(2, len(w))
            w[k] = w[k] + rng.choice("sx")
        title = " ".join(w)
        rows.append((i, i, rng.randrange(5), len(title) + rng.randrange(2), title, rng.choice(["", "2000", "2001", "2003"]), rng.choice(["", "roe"]), rng.choice(["", "", "", "d1", "d2", "d3"])))
    return rows


def passed(spark, rows):
    reps = spark.createDataFrame([(r[0], *r) for r in rows], "cluster long, first long, occ_idx long, p int, l int, norm_title string, year string, author1 string, doi string")
    return reps, resolution.similar_clusters(reps)


def test_reviews_follow_the_sequential_loop(spark, monkeypatch):
    monkeypatch.setattr(resolution, "PART", 20)
    rows = similar_rows()
    reps, states = passed(spark, rows)
    got = resolution.reviews(reps, states).collect()
    want, _ = sequential(rows)
    assert sorted((r.l_occ_idx, r.r_occ_idx, r.decision) for r in got) == want
    assert any(r.jaccard < 0.8 for r in got) and any(r.l_norm_title == r.r_norm_title for r in got)


def test_similar_titles_join_clusters(spark):
    rows = similar_rows()
    reps, states = passed(spark, rows)
    _, root = sequential(rows)
    clusters = reps.select("occ_idx", "cluster", F.col("cluster").alias("exact"))
    final = resolution.after_similar(clusters, states)
    got = {r.occ_idx: r.cluster for r in final.collect()}
    low = {c: min(x for x in root if root[x] == c) for c in root.values()}
    assert got == {x: low[root[x]] for x in root} and len(set(got.values())) < len(rows)
    edges = states.where("edge_l is not null").select(F.col("edge_l").alias("a"), F.col("edge_r").alias("b"), F.lit("FUZZY_TITLE_AUTHOR").alias("reason"))
    _, by_cluster = resolution.basis(edges, final)
    joined = {c for c in got.values() if list(got.values()).count(c) > 1}
    assert {r.cluster for r in by_cluster.where("deduplication_basis = 'FUZZY_TITLE_AUTHOR'").collect()} == joined


def resolve(rows):
    """All passes as loops over rows of (i, system, title, year, doi, url, author): clusters, reasons of each record, conflicts and reviews."""
    root, dois, reasons, conflicts, reviews = {r[0]: r[0] for r in rows}, {r[0]: r[4] for r in rows}, {r[0]: set() for r in rows}, set(), []
    by = {r[0]: r for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b, reason, key):
        x, y = find(a), find(b)
        if x == y:
            return
        if dois[x] and dois[y] and dois[x] != dois[y]:
            conflicts.add((key, reason, dois[x], dois[y], by[a][2], by[b][2]))
            return
        root[y], dois[x] = x, dois[x] or dois[y]
        reasons[a].add(reason)
        reasons[b].add(reason)

    def buckets(key, reason, years=False):
        held = {}
        for r in rows:
            if key(r):
                held.setdefault(key(r), []).append(r)
        for k, (first, *others) in held.items():
            for o in others:
                if not years or not first[3] or not o[3] or abs(int(first[3]) - int(o[3])) <= 1:
                    join(first[0], o[0], reason, k)

    buckets(lambda r: r[4], "DOI")
    buckets(lambda r: r[2] if len(r[2]) >= 15 else "", "EXACT_TITLE_YEAR", years=True)
    buckets(lambda r: r[5], "CANONICAL_URL")
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append(r[0])
    top = {x: max(g, key=lambda i: (resolution.PRIORITY[by[i][1]], len(by[i][2]), -i)) for x, g in groups.items()}
    reps = [(g[0], top[x], resolution.PRIORITY[by[top[x]][1]], len(by[top[x]][2]), by[top[x]][2], by[top[x]][3], by[top[x]][6], dois[x]) for x, g in groups.items()]
    seen, fuzzy = sequential(reps)
    final = {i: fuzzy[g[0]] for g in groups.values() for i in g}
    return final, reasons, conflicts, seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolution_follows_the_sequential_loops(spark, seed):
    rng = random.Random(seed)
    base = ["effects of fine sediment burial on corals", "effects of fine sediment burial on sponges and corals of the deep fjord", "short title", "drill cuttings and the growth of sponges", ""]
    rows = []
    for i in range(1, 141):
        title = rng.choice(base) + rng.choice(["", "", " north", " south"]) * bool(rng.randrange(2))
        url = rng.choice(["", "", *(f"https://a.example/{k}" for k in range(25)), "https://a.example/hot", "https://a.example/hot"])
        rows.append((i, rng.choice(list(resolution.PRIORITY)), title.strip(), rng.choice(["", "2000", "2001", "2004"]), rng.choice([""] * 5 + [f"10.1000/{k}" for k in range(9)]), url, rng.choice(["", "roe", "doe"])))
    df = spark.createDataFrame([(f"OCC{r[0]:06d}", r[0], r[1], r[2], r[6], r[3], r[4], r[5], r[2], r[5], r[6], "", "", "q") for r in rows], "occurrence_id string, occ_idx long, system string, title string, authors string, year string, doi string, url string, norm_title string, canonical_url string, author1 string, abstract_or_snippet string, full_text_status string, query_id string")
    got = resolution.Resolution(df)
    final, reasons, conflicts, seen = resolve(rows)
    parts = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert parts({r.occ_idx: r.cluster for r in got.final.collect()}) == parts(final)
    assert {tuple(r) for r in got.conflicts().collect()} == conflicts and conflicts
    assert sorted((r.l_occ_idx, r.r_occ_idx, r.decision) for r in got.reviews().collect()) == sorted(seen)
    fuzzy_free = {r.occ_idx: set(r.deduplication_basis.split(" | ")) - {"SINGLETON", "FUZZY_TITLE_AUTHOR"} for r in got.provenance().collect()}
    assert fuzzy_free == reasons
    corpus = got.corpus().collect()
    assert len(corpus) == len(set(final.values())) == len({r.corpus_id for r in corpus}) and sum(r.occurrence_count for r in corpus) == len(rows)


def test_round_trips(spark, data):
    assert reference.QUERIES["inverted_index_rebuild"](spark, data).where("not same").count() == 0
    back = reference.QUERIES["ris_import"](spark, data)
    assert back.count() == reference.QUERIES["ris_export"](spark, data).count() > 0


def test_chains_read_written_tables(spark, data):
    parts = pipeline._chained(spark, data)
    read = {name: [f for f in part.inputFiles() if "/records.parquet" in f] for name, part in parts.items()}
    assert [name for name, files in read.items() if files] == ["candidates"]  # the texts of the works found


@pytest.mark.parametrize("share", [resolution.REVIEW_JACCARD, resolution.SAME_AUTHOR[1]])
def test_overlapping_loses_no_pair(spark, share, monkeypatch):
    monkeypatch.setattr(resolution, "LONG", 12)
    rng, rows = random.Random(3), []
    for n in [1, 2, 3, 4, 5, 8, 10, 11, 12, 13, 14, 15, 16, 25] * 4:
        base = [f"word{rng.randrange(60)}of" for _ in range(n)]
        for _ in range(4):
            words = [w if rng.random() > 0.08 else f"other{rng.randrange(9)}" for w in base][: n - rng.randrange(2) if n > 1 else n]
            rows.append((len(rows), list(dict.fromkeys(words))))
    df = spark.createDataFrame([(i, "one", " ".join(w), w) for i, w in rows], "i long, block string, norm_title string, words array<string>")
    got = resolution._overlapping(df, "i", share).collect()
    alike = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {(i, j): alike(v, w) for i, v in rows for j, w in rows if i < j and alike(v, w) >= share}
    assert {(r.l_i, r.r_i): r.jaccard for r in got} == pytest.approx(want) and len(got) == len(want) > 50


def test_words_in_common_beyond_64_bits(spark):
    """Pairs by common words, of short titles and of some that set all bits of the bound, against brute force."""
    rng = random.Random(5)
    known = [f"w{i}" for i in range(300)]
    titles = []
    for n in (4, 9, 12, 45, 55, 120):
        for _ in range(6):
            base = rng.sample(known, n)
            titles += [" ".join(["same", "block", *base]), *(" ".join(["same", "block", *base[k:], *rng.sample(known, k)]) for k in (1, max(1, n // 10), max(1, n // 5)))]
    titles = sorted({t for t in titles if len(t) >= 20})
    sets = [set(t.split(" ")) for t in titles]
    one = resolution._words(spark.createDataFrame(list(enumerate(titles)), "id long, norm_title string"))
    for share in (0.8, 0.88):
        expected = {(i, j) for j in range(len(titles)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= share}
        assert {(r.l_id, r.r_id) for r in resolution._overlapping(one, "id", share).collect()} == expected


def test_address_replay_is_spread(spark):
    """Replays of many small components are not left to one task, which small rows would be coalesced into."""
    n = 4000
    pairs = [(4 * k + i, 4 * k + i, f"u{2 * k + j}", "") for k in range(n // 4) for i, j in ((0, 0), (1, 0), (2, 1), (3, 1))]
    df = spark.createDataFrame([(i, u, d) for i, _, u, d in pairs], "occ_idx long, canonical_url string, doi string")
    clusters = spark.createDataFrame([(i, i) for i in range(n)], "occ_idx long, cluster long")
    unions = resolution.url_unions(df, clusters)
    done = unions._scratch[0]
    assert spark.read.parquet(f"{done.root}/2").rdd.getNumPartitions() > 1
    assert unions.where("what = 'edge'").count() == n // 2


def _made_titles(n, seed):
    """Titles of one block, some of which are others with a few letters changed, put in or left out."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    out = ["short term " + " ".join(rng.choice(words) for _ in range(rng.randint(2, 14))) for _ in range(n // 2)]
    while len(out) < n:
        letters = list(rng.choice(out))
        for _ in range(rng.randint(1, 8)):
            k = rng.randrange(11, len(letters))
            letters[k : k + 1] = rng.choice([[], [rng.choice("aeiou é漢")], [letters[k], "x"]])
        out.append("".join(letters))
    return sorted(set(out))


def _parts(low, high=None):
    rows = [(i, t, 0, 0, int(high is not None)) for i, t in enumerate(low)] + [(len(low) + i, t, 1, 0, 1) for i, t in enumerate(high or [])]
    return pd.DataFrame(rows, columns=["id", "norm_title", "part", "low", "high"])


@pytest.mark.parametrize("short", [512, 60])
def test_close_titles_against_every_pair(monkeypatch, short):
    monkeypatch.setattr(resolution, "TILE", 16)
    monkeypatch.setattr(resolution, "SHORT", short)
    titles = _made_titles(70, 3) + ["short term " + "tide pool " * 30, "short term " + "tide pool " * 29 + "tide pond ", "short term " + "ab" * 300, "short term " + "ab" * 290 + "cd"]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    every = sorted((i, j, r) for i, s in enumerate(titles) for j, t in enumerate(titles) if i != j and (r := ratio(s, t)) >= resolution.REVIEW_RATIO)
    assert sorted(resolution._close(_parts(titles)).itertuples(index=False, name=None)) == every and len(every) > 40
    across = sorted((i, j, r) for i, j, r in every if (i < 30) != (j < 30))
    assert sorted(resolution._close(_parts(titles[:30], titles[30:])).itertuples(index=False, name=None)) == across


def test_a_hot_block_is_compared_in_time():
    """Four million pairs of titles made of the same few words, as in a block of a large table."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(7)) for _ in range(40)]
    titles = ["short term " + " ".join(rng.choice(words) for _ in range(10)) for _ in range(4000)]
    began = time.thread_time()
    resolution._close(_parts(titles[:2000], titles[2000:]))
    assert time.thread_time() - began < 4
