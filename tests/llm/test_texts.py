import random
import string

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewrack.llm import leakage
from tidewrack.llm.leakage import leaked_items
from tidewrack.llm.lookalike import alike_classes, alike_pairs, canonical_values
from tidewrack.llm.names import author_pairs
from tidewrack.llm.sentences import Words, sentences, split_sentences

UNITS = {
    "Dr. Roe saw 4 p.m. light. No. 9 fell (see Fig. 7a). Really?! Yes.": ["Dr. Roe saw 4 p.m. light.", "No. 9 fell (see Fig. 7a).", "Really?!", "Yes."],
    "It fell by 45.9 per cent.Between them, S. pallens grew, i.e. slowly.": ["It fell by 45.9 per cent.", "Between them, S. pallens grew, i.e. slowly."],
    'He said, “Stop!” and left. He wrote: "We lost it at 42 m." Then rest.': ["He said, “Stop!” and left.", 'He wrote: "We lost it at 42 m."', "Then rest."],
    "Results\n\n4. Discussion\n\nWe saw\nit there.\n\n- one item: 5%\n- two. Items": ["Results", "4. Discussion", "We saw\nit there.", "- one item: 5%", "- two. Items"],
    "“能见度太差！”观察员记录。日志写道：“水流很弱。”珊瑚能承受多少？": ["“能见度太差！”观察员记录。", "日志写道：“水流很弱。”", "珊瑚能承受多少？"],
    "「流れは弱い。」と記録した。なんと濁った海だ！": ["「流れは弱い。」と記録した。", "なんと濁った海だ！"],
    "กระแสน้ำอ่อนมาก ฟองน้ำลดลงร้อยละ1.5": ["กระแสน้ำอ่อนมาก", "ฟองน้ำลดลงร้อยละ1.5"],
    "Πόση λάσπη αντέχει; Το ίζημα έπεσε, βλ. σελ. 5. Τέλος": ["Πόση λάσπη αντέχει;", "Το ίζημα έπεσε, βλ. σελ. 5.", "Τέλος"],
    "Le carnet note : « Rien à signaler. » Quelle surprise ! Fin": ["Le carnet note : « Rien à signaler. »", "Quelle surprise !", "Fin"],
    "«Течения нет.» записано в журнале № 3. За 3 ч. Пробы взяты, т. е. все.": ["«Течения нет.» записано в журнале № 3.", "За 3 ч.", "Пробы взяты, т. е. все."],
    "Am 10. Mai 2001 war es trüb, z. B. hier. Ende": ["Am 10. Mai 2001 war es trüb, z. B. hier.", "Ende"],
    "“धारा धीमी है।” ऐसा लिखा है। गाद 5 मि.ग्रा. रही॥": ["“धारा धीमी है।” ऐसा लिखा है।", "गाद 5 मि.ग्रा. रही॥"],
    "هل تعافت؟ كان 9. جمع د. Roe عينات.": ["هل تعافت؟", "كان 9.", "جمع د. Roe عينات."],
    "(See App. E here.) pH fell. eDNA rose.": ["(See App. E here.)", "pH fell.", "eDNA rose."],
    "no stop at all": ["no stop at all"], "": [], "  \n ": [],
}


@pytest.mark.parametrize("text", list(UNITS))
def test_sentences(text):
    assert [text[a:b] for a, b in sentences(text)] == UNITS[text]


GAPS = {
    "นักวิจัยสำรวจพื้นที่ ตะกอนลดลง": ["นักวิจัยสำรวจพื้นที่", "ตะกอนลดลง"],
    "นักวิจัยพบฟองน้ำที่ อ่อนแอมาก": ["นักวิจัยพบฟองน้ำที่ อ่อนแอมาก"],
    "ตัวอย่างต่าง ๆ ถูกเก็บแล้ว น้ำขุ่น": ["ตัวอย่างต่าง ๆ ถูกเก็บแล้ว", "น้ำขุ่น"],
    "「流れは弱い。」とても濁った海だ。": ["「流れは弱い。」", "とても濁った海だ。"],
    "「流れは弱い。」と記録した。": ["「流れは弱い。」と記録した。"],
    "海綿を採集した しかし濁度は超えた。": ["海綿を採集した", "しかし濁度は超えた。"],
    "海綿の ろ過速度を採集した。": ["海綿の ろ過速度を採集した。"],
}


@pytest.mark.parametrize("text", list(GAPS))
def test_gaps_are_judged_by_the_words_beside_them(text):
    assert [text[a:b] for a, b in sentences(text)] == GAPS[text]


def test_the_word_lattice_decides():
    assert Words().segment("สำรวจพื้นที่")[-1] == "พื้นที่" and Words().segment("ฟองน้ำที่")[-1] == "ที่"
    assert Words().segment("とても濁った")[0] == "とても" and Words().segment("と記録した") == ["と", "記録", "した"]
    none = Words(frozenset())
    assert sum(sentences(t, none) != sentences(t) for t in GAPS) >= 4
    assert sentences("「流れは弱い。」と観測員は記録した。なんと濁った海だ！", none) != sentences("「流れは弱い。」と観測員は記録した。なんと濁った海だ！")


def test_the_terminator_lattice_weighs_what_a_path_breaks():
    held = 'He wrote: "It fell. It rose." Then rest.'
    assert [held[a:b] for a, b in sentences(held)] == ['He wrote: "It fell. It rose."', "Then rest."]
    lost = 'The 5" core broke. ' + "It was cold there. " * 12 + 'The 7" core held.'
    assert len(sentences(lost)) == 14  # two inch marks are no quote over fourteen sentences


def test_long_texts_cost_time_in_proportion():
    import time

    def took(text):
        start = time.perf_counter()
        sentences(text)
        return time.perf_counter() - start

    for unit in ("(See it. ) ", "“A b.” ", "Dr. A. ", "a.b.", "ก ข ", "A (b. C [d] e) f. "):
        small, large = took(unit * 1000), took(unit * 8000)
        assert large < 25 * small + 0.5, unit


def test_sentences_cover_every_visible_character():
    rng = random.Random(2)
    letters = string.ascii_letters + " .?!\n\"'()«»“”。！ ก" + "​😀"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        at = 0
        for a, b in sentences(text):
            assert at <= a < b and not text[at:a].replace("\u200b", "").strip() and not text[a].isspace() and not text[b - 1].isspace()
            at = b
        assert not text[at:].replace("\u200b", "").strip()
    assert len(sentences("A long one. " * 20_000)) == 20_000
    assert sentences(None) == []


def test_split_sentences(spark):
    df = spark.createDataFrame([(1, "It fell. It rose.", 0), (2, None, 0), (3, "", 0), (None, "x", 0)], "doc_id long, text string, sent_start int")
    out = split_sentences(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 0, 8), (1, 9, 17), (None, 0, 1)], key=str)
    assert dict(out.dtypes) == {"doc_id": "bigint", "sent_start": "bigint", "sent_end": "bigint"}
    assert split_sentences(df.limit(0)).count() == 0


def test_alike(spark):
    rows = [("a", "Reef café", None), ("b", "Rееf café", "x"), ("c", "Reef café", "x"), ("d", "Reef cafe", "X"), ("e", "Reef café", ""), ("f", "reef café", " "), ("g", "Ｒeef ca​fé", "x"), ("a", "Reef café", None), ("h", None, "x")]
    df = spark.createDataFrame(rows, "k string, title string, authors string")
    got = {(r.k_a, r.k_b, r.field_name) for r in alike_pairs(df, "k", "title", "authors").collect()}
    same = ["a", "b", "c", "e", "g"]
    assert got == {(x, y, "title") for i, x in enumerate(same) for y in same[i + 1 :]}
    forms = {r.k: r.title_canonical for r in canonical_values(df, "title").collect()}
    assert {forms[k] for k in same} == {"Reef café"} and forms["d"] == "Reef cafe" and forms["h"] is None
    assert alike_pairs(df.limit(0), "k", "title").count() == 0


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = {i: words(rng, 30) for i in range(12)}
    docs, want = [], set()
    for d in range(120):
        body = words(rng, 60)
        item = rng.randrange(12)
        n = rng.choice([0, 4, 15, 20, 30])
        start = rng.randrange(30 - n + 1)
        passage = list(items[item][start : start + n])
        if n >= 15:
            want.add((d, item))
            passage[n // 2] = "changed"
        docs.append((d, " ".join(body[:30] + [w.upper() if d % 2 else w for w in passage] + body[30:]).replace("a", "а" if d % 3 else "a")))
    documents = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    held = spark.createDataFrame([*((i, " ".join(w)) for i, w in items.items()), (99, None), (98, "")], "item_id long, text string")
    out = leaked_items(documents, held)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaked_items(documents, held, block=500).collect()} == want
    assert leaked_items(documents.limit(0), held).count() == 0 and leaked_items(documents, held.limit(0)).count() == 0


def test_leak_offsets_point_into_the_original():
    text = "Intro.  Ｎｅｔ 9 caught​ 340 coral nubbins, yet Roe logged 45.4 per cent. End."
    ((item, share, a, b),) = leakage.Leaks([(1, "Net 9 caught 340 coral nubbins, yet Roe logged 45.4 per cent.")]).found(text)
    assert item == 1 and share == 1.0 and text[a:b].startswith("Ｎｅｔ") and text[a:b].endswith("cent")


def test_moulds_are_no_leak():
    mould = "net {} caught {} coral nubbins yet {} logged just {} per cent of all tagged {}"
    items = [(i, mould.format(i, i + 100, f"name{i}", i + 300, f"word{i}")) for i in range(10)]
    assert leakage.Leaks(items).found(mould.format("x", "y", "z", "q", "w")) == []
    assert [h[0] for h in leakage.Leaks(items).found(items[3][1])] == [3]


def test_leaks_do_not_depend_on_the_blocks(spark):
    rng = random.Random(6)
    mould = ["net", "caught", "coral", "nubbins", "yet", "logged", "just", "per", "cent", "of", "all", "tagged", "ones", "in", "may"]
    items = [(i, " ".join([*mould[:5], *words(rng, 3), *mould[5:10], *words(rng, 2), *mould[10:]])) for i in range(40)]
    docs = [(d, " ".join(words(rng, 20) + items[d % 40][1].split()[: 6 + d % 15] + words(rng, 20))) for d in range(120)]
    documents, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [sorted((r.doc_id, r.item_id) for r in leaked_items(documents, held, block=b).collect()) for b in (1 << 20, 2000, 300)]
    assert found[0] == found[1] == found[2] and found[0]


def test_look_alike_marks(spark):
    pairs = ["Stop!", "Stopǃ", "a:b", "a∶b", "low ,", "low ‚", "Part IV", "Part Ⅳ", "What?!", "What⁈"]
    rows = spark.createDataFrame([(f"k{i:02d}", v) for i, v in enumerate(pairs)], "k string, title string")
    assert {(r.k_a, r.k_b) for r in alike_pairs(rows, "k", "title").collect()} == {(f"k{i:02d}", f"k{i + 1:02d}") for i in range(0, len(pairs), 2)}
    classes = alike_classes(rows, "k", "title").collect()
    assert len(classes) == len(pairs) and {r.canonical for r in classes} == set(pairs[::2])


def test_rows_keep_their_place(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("Number "), "id", F.lit(". Next one.")).alias("text")).repartition(9)
    assert split_sentences(df).groupBy("doc_id").count().where("count <> 2").count() == 0


def test_long_author_field(spark, tmp_path):
    spark.createDataFrame([("Roe, Ann | A. Roe", "OpenAlex")], "authors string, system string").write.parquet(str(tmp_path / "records.parquet"))
    rows = [("a", " ".join(["word"] * 3000)), ("b", "Ann Roe")]
    spark.createDataFrame(rows, "paper_id string, authors string").write.parquet(str(tmp_path / "ss_mech_feeding_pumping_sponge_01.parquet"))
    pairs = {(r.name_a, r.name_b) for r in entry.queries()["p5_found"](spark, str(tmp_path)).collect()}
    assert ("Ann Roe", "Roe, Ann") in pairs


def test_long_surname(spark):
    """A surname of 20,000 letters and slips of it, one also at the bound of forms."""
    rng = random.Random(7)
    long, edge = ("".join(rng.choice(string.ascii_lowercase) for _ in range(n)) for n in (20_000, 64))
    middle = len(long) // 2
    turned = long[:middle] + long[middle + 1] + long[middle] + long[middle + 2 :]
    names = [f"{s.title()}, Ann" for s in (long, long[:7] + "q" + long[7:], turned, edge, edge + "q", long[::-1])]
    found = author_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {frozenset(names.index(n) for n in row) for row in found} >= {frozenset((0, 1)), frozenset((0, 2)), frozenset((3, 4))}
    assert not any(names[5] in row for row in found)
