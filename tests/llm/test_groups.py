import random

from pyspark.sql import functions as F

from tidewrack.llm.groups import components, link_groups, record_keys
from tidewrack.llm import identifiers as I
from tidewrack.llm.survivors import fit_spread, survivors


def roots(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def parts(labels):
    out = {}
    for x, r in labels.items():
        out.setdefault(r, set()).add(x)
    return {frozenset(s) for s in out.values()}


def test_components_of_random_graphs_chains_and_stars(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5001 + i) for i in range(80)] + [(5, 5)]
    want = roots([p for p in pairs if p[0] != p[1]])
    df = spark.createDataFrame([*pairs, *pairs[:20], (None, 3), (4, None)], "a long, b long")
    once = {r.node: r.root for r in components(df).collect()}
    assert parts(once) == parts(want)
    assert once == {r.node: r.root for r in components(df.repartition(7, F.rand(1))).collect()}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1), (None, None)], "a long, b long")).count() == 0


COLUMNS = "occurrence_id string, title string, doi string, url string, system string, abstract_or_snippet string, full_text_status string, retrieved_date string"
ROWS = [
    ("o1", "Silt and corals of the north", "10.1234/abc", None, "OpenAlex", "Short.", "not identified", "2024-01-01"),
    ("o2", "SILT & CORALS OF THE NORTH.", None, "https://a.example/x", "semantic  scholar", "A longer real text.", None, "2024-01-01"),
    ("o3", None, "doi:10.1234/ABC.", "http://www.a.example/y", "Grey literature", "No abstract available.", "Archived", None),
    ("o4", "Other", None, "https://a.example//x/?utm_source=q#s", "Citation chaining", "A longer real text.", "", "2024-02-01"),
    ("o5", "Editorial", "n/a", "https://a.example/login", "OpenAlex", None, None, None),
    ("o6", "editorial", "10.0000/0000000", "https://a.example/login", "OpenAlex", None, None, None),
    ("o7", None, None, None, None, None, None, None),
    ("o8", "", "", "https://doi.example/10.1234%2Fabc", "Web of Science", "", "OPEN_ACCESS_PDF", "2023-01-01"),
    ("o8", "", "", "https://doi.example/10.1234%2Fabc", "Web of Science", "", "OPEN_ACCESS_PDF", "2023-01-01"),
]


def test_groups_and_survivors(spark):
    records = spark.createDataFrame(ROWS, COLUMNS)
    groups = link_groups(record_keys(records))
    got = {r.occurrence_id: r.group_id for r in groups.collect()}
    assert got == dict.fromkeys(("o1", "o2", "o3", "o4", "o8"), "o1")
    assert groups.count() == 5
    # The longest text is a stand-in, as other works show that carry it beside their own texts.
    others = [r for i in range(6) for r in ((f"p{i}", f"Work number {i} on silt", None, None, "OpenAlex", f"Text {i}.", None, None), (f"q{i}", f"Work number {i} on silt", None, None, "Grey literature", "NO ABSTRACT available", None, None))]
    more = records.unionByName(spark.createDataFrame(others, COLUMNS))
    rows = survivors(more, link_groups(record_keys(more))).collect()
    assert {r.field_name: r.occurrence_id for r in rows if r.group_id == "o1"} == {"doi": "o1", "abstract_or_snippet": "o4", "full_text_status": "o3"}
    assert {r.occurrence_id for r in rows if r.group_id != "o1" and r.field_name == "abstract_or_snippet"} == {f"p{i}" for i in range(6)}
    assert {r.field_name for r in survivors(more, groups, prior="votes").collect()} == {"doi", "abstract_or_snippet", "full_text_status"}
    assert survivors(records.limit(0), groups).count() == 0


TEXTS = "occurrence_id string, group_id string, system string, abstract_or_snippet string, doi string, full_text_status string, retrieved_date string"


def texts(spark, rows):
    df = spark.createDataFrame([(f"o{i:04d}", *r, None, None, None) for i, r in enumerate(rows)], TEXTS)
    return df.drop("group_id"), df.select("occurrence_id", "group_id")


def test_copied_votes_are_discounted(spark):
    """A real text that A has under one work and its copier B under another one is false only if B counts as a witness."""
    rows = [(f"{s}{i}", s, f"{s} {i} wrote a text of its own that nobody else has.") for s in "AB" for i in range(100)]
    for i in range(30):
        rows += [(f"x{i}", "A", "Please log on to read this text, as the others do."), (f"x{i}", "B", "Please log on to read this text, as the others do."), (f"x{i}", "C", f"Real text {i}.")]
    rows += [("y1", "A", "One real text that was found twice, and the two never linked."), ("y1", "C", "Real y1."), ("y2", "B", "One real text that was found twice, and the two never linked."), ("y2", "C", "Real y2.")]
    records, groups = texts(spark, rows)
    best = lambda **how: {r.group_id: rows[int(r.occurrence_id[1:])][2] for r in survivors(records, groups, **how).collect()}
    with_, without = best(), best(copies=False)
    assert with_["y1"] == with_["y2"] == rows[-4][2] and without["y1"] == "Real y1."
    assert all(with_[f"x{i}"] == f"Real text {i}." for i in range(30))


def test_votes_choose_what_independent_sources_say(spark):
    rows = [(f"g{i}", s, f"Text {i} in {s}, the longest of all." if s == "D" else f"Text {i}.") for i in range(40) for s in "ABCD"]
    records, groups = texts(spark, rows)
    said = lambda prior: {rows[int(r.occurrence_id[1:])][1] for r in survivors(records, groups, prior=prior).collect()}
    assert said("order") == {"D"} and "D" not in said("votes")


def test_spread_model():
    real, false = fit_spread([(8.0, 50), (1.0, 3)], 5000)
    assert real < 0.01 and false > 0.8
    assert fit_spread([], 0) == fit_spread([], 0)
    # The same shares at a thousand times the size give the same chances.
    a, b = fit_spread([(8.0, 50), (1.0, 3)], 5000), fit_spread([(8.0, 50_000), (1.0, 3000)], 5_000_000)
    assert all(abs(x - y) < 0.02 for x, y in zip(a, b))


def test_keys(spark):
    key = lambda f, v: spark.range(1).select(f(F.lit(v)).alias("x")).first().x
    assert key(I.doi_key, "10.0000/0000000") is None and key(I.doi_text, "10.0000/0000000") == "10.0000/0000000"
    assert key(I.doi_text, "10.1234/") is None and key(I.doi_key, "doi:10.1234/Ab(c).") == "10.1234/ab(c)"
    assert key(I.page_key, "https://www.a.example:443//x/?utm_medium=q#s") == "a.example/x"
    assert key(I.page_key, "https://a.example/login") is None
    assert key(I.title_key, "Editorial.") is None
    assert key(I.title_key, "A <i>Rееf</i> &amp; Silt") == "reef and silt"


def test_abstract_shared_by_many_groups_survives(spark):
    text = "Fragments buried under crushed rock dust varied more than expected while respiration stayed flat."
    rows = [(f"o{i:03d}", "OpenAlex", None, text if i % 2 else "A shorter one.", None, None) for i in range(60)]
    records = spark.createDataFrame(rows, "occurrence_id string, system string, doi string, abstract_or_snippet string, full_text_status string, retrieved_date string")
    groups = records.select("occurrence_id", F.format_string("g%02d", (F.substring("occurrence_id", 2, 3).cast("int") / 2).cast("int")).alias("group_id"))
    assert {r.occurrence_id for r in survivors(records, groups).collect()} == {r[0] for r in rows if r[3] == text}


def test_extra_columns_do_not_clash(spark):
    records = spark.createDataFrame([(*r, "x", "y") for r in ROWS], COLUMNS + ", keys string, group_id string")
    assert link_groups(record_keys(records)).count() == 5


def test_hot_key_is_one_node(spark):
    rows = spark.range(3000).select(F.format_string("o%05d", "id").alias("occurrence_id"), F.when(F.col("id") % 3 == 0, "One title that a third shares").otherwise(F.concat(F.lit("Title number "), "id")).alias("title"), F.lit(None).cast("string").alias("doi"), F.lit("").alias("url"))
    got = link_groups(record_keys(rows))
    assert got.count() == 1000 and got.select("group_id").distinct().count() == 1
