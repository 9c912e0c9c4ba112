import pytest
from pyspark.sql import functions as F

from tidewrack.llm.names import author_pairs, trimmed
from tidewrack.operators.packed import resolve, split_values, unpack

LISTS = {
    "a | b||c": ["a", "b", "c"], "x; y ;z;": ["x", "y", "z"], "a, b & c": ["a", "b", "c"], "A and B": ["A", "B"], '"a, 1"; b': ["a, 1", "b"],
    r"a\tb": ["atb"], "a\tb\\, c": ["a", "b, c"], '["a", "b; c"]': ["a", "b; c"], "['a', 'b']": ["a", "b"], "{a,b}": ["a", "b"], "a；b、c": ["a", "b", "c"],
    "a / b": ["a", "b"], "a/b": ["a/b"], "one": ["one"], '"q""q"|b': ['q"q', "b"], "[broken": ["[broken"], "; ;": [], "a | a": ["a", "a"], "a\nb": ["a", "b"],
}
NAMES = {
    "Roe, A.; B. Doe": ["Roe, A.", "B. Doe"], "Ann Roe, Bob Doe": ["Ann Roe", "Bob Doe"], "Roe, Ann": ["Roe, Ann"], "von Roe, A. B.": ["von Roe, A. B."],
    "Roe, A and Doe, B": ["Roe, A", "Doe, B"], "Ann Roe, Bob Doe & Cy Poe": ["Ann Roe", "Bob Doe", "Cy Poe"], 'Ann "Annie" Roe; B. Doe': ['Ann "Annie" Roe', "B. Doe"],
    "Oslo Institute of Marine and Coastal Survey": ["Oslo Institute of Marine and Coastal Survey"], "Ann Roe and Oslo Institute of Marine and Coastal Survey": ["Ann Roe", "Oslo Institute of Marine and Coastal Survey"],
    '"Roe, A.","Doe, B."': ["Roe, A.", "Doe, B."], '["Ann \\"Annie\\" Roe", "Doe, B."]': ['Ann "Annie" Roe', "Doe, B."],
}


def values(spark, cases, names):
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(cases)], "k string, packed string")
    out = split_values(df, F.col("k"), {"packed": names}).orderBy("record_key", "value_pos").collect()
    got = {str(i): [] for i in range(len(cases))}
    for r in out:
        got[r.record_key].append(r.value)
        assert r.value_pos == len(got[r.record_key])
    return [got[str(i)] for i in range(len(cases))]


@pytest.mark.parametrize(("cases", "names"), [(LISTS, False), (NAMES, True)])
def test_values(spark, cases, names):
    for case, got in zip(cases, values(spark, list(cases), names)):
        assert got == cases[case], case


def test_edges(spark):
    long = ";".join(f"v{i}" for i in range(20_000))
    df = spark.createDataFrame([("a", None, 1), ("b", "", 1), ("c", "  ", 1), ("d", "x; y", 1), ("d", "x; y", 2), (None, "z", 1), ("e", long, 1)], "k string, packed string, value int")
    out = split_values(df, F.col("k"), {"packed": False})
    assert out.columns == ["field_name", "record_key", "value_pos", "value"]
    rows = {(r.record_key, r.value_pos): r.value for r in out.collect()}
    assert len(rows) == out.count() == 20_003
    assert rows[("d", 2)] == "y" and rows[(None, 1)] == "z" and rows[("e", 20_000)] == "v19999"
    assert split_values(df.limit(0), F.col("k"), {"packed": True}).count() == 0


def test_rules_never_raise():
    for skeleton in ("", "#", '"#', "[#,", "\\#;#", "{#,#x"):
        for names in (True, False):
            kind, pattern = resolve(skeleton, names)
            unpack('a;"b', kind, pattern)


def test_long_fields(spark):
    n = 3000
    cases = {" ".join(["word"] * n): 1, " ".join(["Marine"] * n) + " Institute": 1, ", ".join(f"Ann Name{i}" for i in range(n)): n, "; ".join(f'"Name{i}, A."' for i in range(n)): n}
    assert [len(v) for v in values(spark, cases, True)] == list(cases.values())


def test_empty_parts_between_commas(spark):
    """Beside other names; before, the rule of such a field was an error that ended the query."""
    cases = {
        "Ann Roe, , Oslo Institute of Marine Survey, Bergen": ["Ann Roe", "Oslo Institute of Marine Survey, Bergen"], "Oslo Institute of Marine Survey, Bergen, , Ann Roe,": ["Oslo Institute of Marine Survey, Bergen", "Ann Roe"],
        "Ann Roe, , Doe, Bob &": ["Ann Roe, , Doe, Bob"], "Roe, Ann, , Doe, Bob": ["Roe, Ann", "Doe, Bob"], "Ann Roe &  & Doe, Bob": ["Ann Roe", "Doe, Bob"],
    }
    for case, got in zip(cases, values(spark, list(cases), True)):
        assert got == cases[case], case


def test_halves_of_characters(spark):
    assert values(spark, ['["Roe \\ud83d", "B\\u00e9 \\ud835\\udc00"]', "['Roe \\ud83d', 'B \\ud835\\udc00']"], True) == [["Roe �", "Bé \U0001d400"], ["Roe �", "B \U0001d400"]]


def test_authors_with_empty_parts_are_paired(spark):
    """What p5_found does with the field."""
    df = spark.createDataFrame([("a", "Ann Berta Roe, , Doe, Bob &"), ("b", "Cyrus Poe, , Oslo Institute of Marine Survey, Bergen"), ("c", "Poe, Cyrus")], "k string, authors string")
    found = author_pairs(trimmed(split_values(df, F.col("k"), {"authors": True}).select(F.col("value").alias("name"))))
    assert ("Cyrus Poe", "Poe, Cyrus") in {(r.name_a, r.name_b) for r in found.collect()}
