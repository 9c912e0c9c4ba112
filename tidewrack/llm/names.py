"""Variant spellings of names typed by people and organisations.

Every distinct spelling is read into parts (surname or seat, given name or kind,
initials), through token order, particles, look-alikes, accents, legal and
stop words. Every reading is rewritten into all its canonical forms: the formal
names a nickname stands for, each initial, and the forms with one letter left
out, which two spellings one slip apart share. Forms are exploded and
equi-joined; a link made by a slip is scored by the rarity of its rewriting: the
support of the rarer form, the number of distinct readings that have it, is weighed
against that of its neighbour, so that two well-attested names one letter apart stay
two at any size of the data. A short form of a corporate name links only if it is a
rewriting of one full name of that seat.

Spellings that read the same are merged before any join, links are found between
these readings, components are hooked, and only the result is spelt out again.
Nothing is gathered per name: a surname that a third of all authors share is a
skewed join key at worst, never one task's group. Readings are 64-bit hashes; at n
readings two of them collide with a chance of about n*n/2**65.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import unicode as U
from tidewrack.llm.groups import components
from tidewrack.llm.nicknames import formal_names
from tidewrack.llm.survivors import source_label
from tidewrack.operators.packed import CORPORATE, PARTICLES
from tidewrack.session import Scratch

#: A form is no slip if, two standard deviations off chance, it still has this share of its neighbour's support.
ATTESTED = 0.1
#: Slips are only looked for in words of this length or more.
SLIP_LENGTH = 5
#: Words beyond this length meet on thirds, as their forms with one letter left out would grow with the square of it.
LONG_WORD = 64
#: Given names are broadcast up to this many; beyond it the join shuffles.
MAX_BROADCAST = 200_000

# Short forms of words of corporate names, words that change nothing, and legal forms.
SHORT = {"inst": "institute", "ctr": "centre", "cntr": "centre", "cent": "centre", "center": "centre", "agcy": "agency", "agy": "agency", "univ": "university", "dept": "department", "lab": "laboratory", "assoc": "association", "soc": "society", "org": "organisation", "organization": "organisation", "comm": "commission", "admin": "administration", "natl": "national", "intl": "international"}
STOP = frozenset("the of for and de la du des der die das und et y e i og o a an in at on och voor van".split())
LEGAL = frozenset("ltd limited inc incorporated corp corporation co gmbh ag kg sa sas sarl bv nv as asa ab oy aps plc llc llp srl spa pty kk".split())
# Words that name a body or, beside another such word, what it does.
SUBJECTS = frozenset("survey observatory programme program service network group trust".split())
_TYPES = frozenset(w.lower() for w in CORPORATE) | frozenset(SHORT.values())
_LOOK = str.maketrans(U.LOOKALIKE_FROM, U.LOOKALIKE_TO)
_BASE = str.maketrans(U.LETTERS_WITHOUT_DECOMPOSITION)
_QUOTED = re.compile(r"[\"“”„‘(]([\w' -]{2,20})[\"“”’)]")


def plain(name: str) -> str:
    """One form per look and kind of hyphen, without accents, case kept."""
    if name.isascii():
        return " ".join(name.split())
    out = "".join(c for c in name if unicodedata.category(c) != "Cf")
    out = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", out).translate(_LOOK).translate(_BASE))
    return " ".join(re.sub("[‐‑−‒]", "-", "".join(c for c in out if not unicodedata.combining(c))).split())


def _fold(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum())


def _initials(words: list[str]) -> str:
    """Initials of given names: of every part of a joined one, and of letters typed together."""
    out = []
    for w in words:
        for part in re.split(r"[-.\s]+", w):
            if not part:
                continue
            if len(part) > 1 and not part.isupper():
                out += [part[0], *[c for c in part[1:] if c.isupper()]] if part[0].isupper() else [part[0]]
            else:
                out += list(part)
    return _fold("".join(out))


def _is_initials(word: str) -> bool:
    return bool(re.fullmatch(r"(?:[^\W\d_]\.?-?){1,3}", word)) and (word.isupper() or "." in word)


def _first(given: str) -> str:
    """The first part of a joined given name."""
    return _fold(given.split("-")[0] if given.isupper() else re.split(r"(?<=[a-z])(?=[A-Z])|[-.]", given)[0])


def read(name: str) -> tuple[str, ...] | None:
    """(kind, surname, given, initials, and the last three in the other order): the parts of a spelling, folded.

    None if it has no letter. The parts in the other order are empty where the
    spelling leaves no doubt. ``given`` is empty where only
    initials are known. Of an organisation, the seat is the surname and the kind
    with its first and last subject the given name.
    """
    text = plain(name)
    bare = _QUOTED.sub(" ", text)
    if re.search(r"\w", bare):
        text = bare
    words = re.findall(r"[^\W_]+(?:['’.-]+[^\W_]+)*\.?|[,;]", text)
    if not any(w not in ",;" for w in words):
        return None
    folded = [SHORT.get(_fold(w), _fold(w)) for w in words]
    if any(f in _TYPES for f in folded) and len([f for f in folded if f]) >= 3:
        return _read_body(words, folded, [w.endswith(".") and len(f) > 2 and _fold(w) == f for w, f in zip(words, folded)])
    comma = words.index(",") if "," in words else -1
    words = [w for w in words if w not in ",;"] if comma < 0 else words
    other = False
    if comma > 0 and comma < len(words) - 1:
        last, given = words[:comma], [w for w in words[comma + 1 :] if w not in ",;"]
        given = [w for w in given if w not in PARTICLES] or given
    else:
        words = [w for w in words if w not in ",;"]
        small = [i for i, w in enumerate(words) if w in PARTICLES]
        marks = [i for i, w in enumerate(words) if _is_initials(w)]
        if len(words) == 1:
            last, given = words, []
        elif small and small[0] == 0 and small[-1] + 1 < len(words):
            last, given = words[: small[-1] + 2], words[small[-1] + 2 :]
        elif small:
            last, given = words[small[0] :], words[: small[0]]
        elif marks and marks[-1] == len(words) - 1 and len(marks) < len(words):
            n = next(i for i in range(len(words) - 1, -1, -1) if not _is_initials(words[i])) + 1
            last, given = words[:n], words[n:]
            if n > 1:
                last, given = words[n - 1 : n], words[: n - 1] + words[n:]
                if n == 2:  # Given Surname M
                    last, given, other = words[1:2], [words[0], *words[2:]], False
        else:
            last, given = words[-1:], words[:-1]
            if not marks and len(words) == 2:
                other = True
    surname = "".join(_fold(w) for w in last if w not in PARTICLES) or "".join(map(_fold, last))
    turned = (_fold(words[0]), _first(words[-1]), _initials([words[-1], *words[1:-1]])) if other else ("", "", "")
    return "p", surname, _first(next((w for w in given if not _is_initials(w)), "")), _initials(given), *turned


def _read_body(words: list[str], folded: list[str], cut: list[bool]) -> tuple[str, ...]:
    comma = words.index(",") if "," in words else -1
    short = {f for f, c in zip(folded, cut) if c}
    seat = ""
    if comma > 0 and any(f in _TYPES for f in folded[:comma]) and not any(f in _TYPES for f in folded[comma + 1 :]):
        seat, folded = "".join(folded[comma + 1 :]), folded[:comma]
    rest = [f for f in folded if f and f not in STOP and f not in LEGAL]
    if not seat:
        at = next((i for i, f in enumerate(rest) if f not in _TYPES), 0)
        seat, rest = rest[at], rest[:at] + rest[at + 1 :]
    kind = next((f for f in rest if f in _TYPES and f not in SUBJECTS), next((f for f in rest if f in _TYPES), ""))
    subjects = [f + "." * (f in short) for f in rest if f != kind]
    return "c", seat, "|".join([kind, *(subjects[:1] + subjects[-1:] if len(subjects) > 1 else subjects)]), "", "", "", ""


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, parts = [], []
        for i, name in enumerate(batch.column(0).to_pylist()):
            got = read(name)
            if got and got[1]:
                rows.append(i)
                parts.append(got)
        columns = [pa.array(c, pa.string()) for c in (zip(*parts) if parts else [[]] * 7)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["name", "kind", "surname", "given", "initials", "other", "other_given", "other_initials"])


def without_one(x: Column) -> Column:
    """The word and all forms of it with one letter left out; short words only themselves, long ones themselves and their thirds.

    Two long words that share a form share a third as well; those of ``LONG_WORD`` + 1
    letters have both, for those with one letter less.
    """
    n = F.length(x)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, n)))
    forms = F.when((n >= SLIP_LENGTH) & (n <= LONG_WORD + 1), F.array_distinct(F.concat(F.array(x), cut))).otherwise(F.array(x))
    return F.when(n > LONG_WORD, F.concat(forms, _thirds(x))).otherwise(forms)


def _thirds(x: Column) -> Column:
    """The first and last third of a word, at its own length and at one letter less, and its middle but for its first or last letter."""
    n = F.length(x)
    third = lambda m: F.floor(m / 3).cast("int")
    ends = [F.concat(F.lit(mark), m.cast("string"), F.lit(mark), F.substring(x, start, third(m))) for m in (n, n - 1) for mark, start in (("^", F.lit(1)), ("$", n - third(m) + 1))]
    middle = [F.concat(F.lit("|"), n.cast("string"), F.lit("|"), F.substring(x, third(n) + k, n - 2 * third(n) - 1)) for k in (1, 2)]
    return F.array_distinct(F.array(*ends, *middle))


def _one_slip(a: Column, b: Column) -> Column:
    """One letter more, less or other, or two neighbours changed over."""
    apart = F.levenshtein(a, b, 2)
    swapped = (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    short = F.greatest(F.length(a), F.length(b)) <= LONG_WORD + 1
    return F.when(short, (apart.between(0, 1)) | ((apart == 2) & swapped)).when(a == b, True).otherwise(_one_slip_long(a, b))


def _one_slip_long(a: Column, b: Column) -> Column:
    """``_one_slip`` of two unlike words by the first letter and the last one that differ: the distance takes the square of their length."""
    differs = lambda x, y: F.array_position(F.zip_with(F.split(x, ""), F.split(y, ""), lambda c, d: ~c.eqNullSafe(d)), True)
    n, m = F.length(a), F.length(b)
    first, last = differs(a, b), differs(F.reverse(a), F.reverse(b))
    other, turned = n - last + 1 == first, (n - last == first) & (F.reverse(F.substring(a, first, F.lit(2))) == F.substring(b, first, F.lit(2)))
    return F.when(n == m, other | turned).when(F.abs(n - m) == 1, first + last - 2 >= F.least(n, m)).otherwise(False)


def _spelt_alike(a: Column, b: Column) -> Column:
    """Surnames that differ only in letters written as two: aa, ae, oe, ue."""
    one = lambda x: F.regexp_replace(F.regexp_replace(x, "a[ae]", "a"), "([ou])e", "$1")
    return one(a) == one(b)


def _agree(a: Column, b: Column) -> Column:
    """Initials of which one begins the other."""
    return a.startswith(b) | b.startswith(a)


def _rare(n: Column, m: Column) -> Column:
    """Whether the rarer of two forms with supports ``n`` and ``m`` may be a slip of the other one.

    Its support less two standard deviations of a Poisson count must not exceed
    ``ATTESTED`` of the other's; what is seen a few times only is never attested.
    """
    low, high = F.least(n, m).cast("double"), F.greatest(n, m)
    return low - 2 * F.sqrt(low) <= ATTESTED * high


def _small_as(kept: DataFrame, df: DataFrame) -> DataFrame:
    """``df``, made of the written table ``kept``, to be broadcast if that is small."""
    return F.broadcast(df) if kept.measured["rows"] <= MAX_BROADCAST else df


def _full_bodies(full: DataFrame) -> DataFrame:
    """(a, b): corporate names with words cut short, and the one full name of their seat that they rewrite.

    They meet on the canonical rewriting of both, three letters of each subject; a
    short form that fits several full names links none of them.
    """
    parts = full.where("kind = 'c'").select("node", "surname", F.split("given", r"\|").alias("parts"))
    head = F.transform("parts", lambda w, i: F.when(i == 0, w).otherwise(F.substring(w, 1, 3)))
    keyed = parts.withColumn("key", F.concat_ws("|", head)).withColumn("cut", F.exists("parts", lambda w: w.endswith(".")))
    short = keyed.where("cut").select(F.col("node").alias("a"), "surname", "key", F.col("parts").alias("pa"))
    whole = keyed.where("not cut").select(F.col("node").alias("b"), "surname", "key", F.col("parts").alias("pb"))
    fits = F.forall(F.arrays_zip("pa", "pb"), lambda z: F.when(z["pa"].endswith("."), z["pb"].startswith(F.rtrim(z["pa"], F.lit(".")))).otherwise(z["pa"] == z["pb"]))
    met = short.join(whole, ["surname", "key"]).where(fits)
    return met.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("most")).where("b = most").select("a", "b")


def entries(records: DataFrame) -> DataFrame:
    """(name): the distinct entries of records.authors, without outer blanks; how a system joins them is known."""
    plain_split = F.split("authors", r"\|")
    joined = F.when(source_label(F.col("system")) == "SEMANTIC SCHOLAR", F.split("authors", ";")).otherwise(plain_split)
    return trimmed(records.where("authors is not null").select(F.explode(joined).alias("name")))


def trimmed(names: DataFrame) -> DataFrame:
    """Distinct non-empty ``name`` without outer blanks."""
    return names.select(F.regexp_replace("name", r"\A[\s ]+|[\s ]+\z", "").alias("name")).where("name <> ''").distinct()


def author_members(names: DataFrame) -> DataFrame:
    """(author, name): every spelling under the author it denotes, a 64-bit id; the same on every run.

    A spelling with initials only stands under every author it may denote. ``names``
    is (name); null and empty names, and those without a letter, are left out, and
    repeated names count once.
    """
    scratch = Scratch(names.sparkSession, "names")
    parts = "name string, kind string, surname string, given string, initials string, other string, other_given string, other_initials string"
    read_ = scratch.keep(names.where("name is not null").distinct().mapInArrow(_readings, parts))

    # Where the order is open, the words' use in names of known order decides: as given name, of so many surnames, or as surname.
    sure = read_.where("kind = 'p' and given <> '' and other = ''").select("surname", "given").distinct()
    uses = sure.select(F.explode(F.array(F.struct(F.col("given").alias("word"), F.lit(1).alias("g"), F.lit(0).alias("s")), F.struct(F.col("surname").alias("word"), F.lit(0).alias("g"), F.lit(1).alias("s")))).alias("u")).select("u.*")
    known = scratch.keep(uses.groupBy("word").agg((F.sum("g") + 0.5).alias("as_given"), (F.sum("s") + 0.5).alias("as_surname")))
    use = lambda word, p: _small_as(known, known.select(F.col("word").alias(word), F.col("as_given").alias(f"{p}_given"), F.col("as_surname").alias(f"{p}_surname")))
    flagged = read_.where("other <> ''").join(use("given", "first"), "given", "left").join(use("other_given", "last"), "other_given", "left").na.fill(0.5)
    turned = F.col("last_given") * F.col("first_surname") > F.col("first_given") * F.col("last_surname")
    settled = flagged.select("name", "kind", *[F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("surname", "other"), ("given", "other_given"), ("initials", "other_initials"))])
    people = read_.where("other = ''").select("name", "kind", "surname", "given", "initials").unionByName(settled)
    formal = F.broadcast(names.sparkSession.createDataFrame([(k, f) for k, v in formal_names().items() for f in v], "given string, formal string"))  # a fixed list
    people = people.withColumn("node", F.xxhash64("kind", "surname", F.when(F.col("given") != "", F.col("given")).otherwise(F.concat(F.lit("~"), "initials"))))
    people = scratch.keep(people)

    # The support of a surname: its distinct readings; of a given name: the surnames it stands beside.
    merged = scratch.keep(people.groupBy("node", "kind", "surname", "given").agg(F.collect_set("initials").alias("initials")))
    support = merged.groupBy("kind", "surname").agg(F.count("*").alias("readings"))
    beside = merged.where("given <> '' and kind = 'p'").groupBy("given").agg(F.count("*").alias("beside"))
    nodes = scratch.keep(merged.join(support, ["kind", "surname"]).join(beside, "given", "left").na.fill(0, ["beside"]))
    full = nodes.where("given <> ''")

    # Full names: a nickname and its formal name, or one slip in surname or given name.
    alias = full.join(formal, "given").where("kind = 'p'").select("kind", "surname", F.col("formal").alias("given"), "node")
    nick = alias.join(full.select("kind", "surname", "given", F.col("node").alias("other")), ["kind", "surname", "given"]).select(F.col("node").alias("a"), F.col("other").alias("b"))
    called = alias.join(beside, "given", "left").na.fill(0, ["beside"]).join(nodes.select("node", "readings"), "node")
    forms = scratch.keep(full.select("node", "kind", "surname", "given", "readings", "beside").unionByName(called.select("node", "kind", "surname", "given", "readings", "beside")))
    by_surname = forms.select("node", "kind", "surname", "given", "readings", F.explode(without_one(F.col("surname"))).alias("form"))
    x, y = by_surname.alias("x"), by_surname.alias("y")
    slipped = (_rare(F.col("x.readings"), F.col("y.readings")) & _one_slip(F.col("x.surname"), F.col("y.surname"))) | _spelt_alike(F.col("x.surname"), F.col("y.surname"))
    slips = x.join(y, ["kind", "form", "given"]).where((F.col("x.surname") < F.col("y.surname")) & slipped).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    by_given = forms.where("kind = 'p'").select("node", "surname", "given", "beside", F.explode(without_one(F.col("given"))).alias("form"))
    x, y = by_given.alias("x"), by_given.alias("y")
    givens = x.join(y, ["surname", "form"]).where((F.col("x.given") < F.col("y.given")) & (F.col("x.node") != F.col("y.node")) & _rare(F.col("x.beside"), F.col("y.beside")) & _one_slip(F.col("x.given"), F.col("y.given"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    edges = nick.unionByName(slips).unionByName(givens).unionByName(_full_bodies(full))
    rooted = full.join(components(edges), "node", "left").select("node", "kind", "surname", "given", "initials", "readings", F.coalesce("root", "node").alias("entity"))
    rooted = scratch.keep(rooted)

    # Initials only: every full name of the surname, or one slip from it, whose initials agree.
    short = nodes.where("given = '' and kind = 'p'").select("node", "surname", "readings", F.explode("initials").alias("i"))
    asks = short.select("node", "i", "surname", "readings", F.explode(without_one(F.col("surname"))).alias("form"))
    initial = F.array_distinct(F.concat(F.transform("initials", lambda i: F.substring(i, 1, 1)), F.array(F.substring("given", 1, 1))))
    as_formal = F.transform("initials", lambda i: F.concat(F.substring("formal", 1, 1), i.substr(F.lit(2), F.length(i))))
    called = rooted.join(formal, "given").withColumn("initials", as_formal).withColumn("given", F.col("formal")).drop("formal")
    offers = rooted.unionByName(called.select(rooted.columns)).where("kind = 'p'").select("entity", F.col("surname").alias("sb"), F.col("readings").alias("rb"), F.col("initials").alias("known"), F.explode(without_one(F.col("surname"))).alias("form"), initial.alias("firsts")).select("entity", "sb", "rb", "known", "form", F.explode("firsts").alias("first"))
    met = asks.withColumn("first", F.substring("i", 1, 1)).join(offers, ["form", "first"])
    same = F.col("surname") == F.col("sb")
    fits = F.exists("known", lambda k: _agree(F.col("i"), k))
    met = met.where((same | (_rare(F.col("readings"), F.col("rb")) & _one_slip(F.col("surname"), F.col("sb"))) | _spelt_alike(F.col("surname"), F.col("sb"))) & fits)
    belongs = scratch.keep(met.select("node", "entity").distinct())

    # Initials only, without any full name: those that agree, under the longest.
    alone = short.join(belongs.select("node").distinct(), "node", "left_anti")
    asks = alone.select("node", "i", "surname", "readings", F.substring("i", 1, 1).alias("first"), F.explode(without_one(F.col("surname"))).alias("form"))
    pair = asks.alias("x").join(asks.alias("y"), ["form", "first"]).where("x.node <> y.node").where((F.col("x.surname") == F.col("y.surname")) | (_rare(F.col("x.readings"), F.col("y.readings")) & _one_slip(F.col("x.surname"), F.col("y.surname"))))
    pair = pair.where(F.col("y.i").startswith(F.col("x.i")))
    longest = pair.select(F.col("x.node").alias("node"), F.col("y.node").alias("entity")).distinct()
    members = rooted.select("node", "entity").unionByName(belongs).unionByName(longest).unionByName(alone.select("node", F.col("node").alias("entity"))).distinct()
    spelt = members.join(people.select("node", "name"), "node").select(F.col("entity").alias("author"), "name").distinct()
    spelt._scratch = scratch
    return spelt


def author_pairs(names: DataFrame) -> DataFrame:
    """(name_a, name_b): two spellings that denote one author, the smaller first.

    ``names`` as for ``author_members``, whose rows grow with the names only; use
    those where pairs are not asked for.
    """
    scratch = Scratch(names.sparkSession, "authors")
    spelt = scratch.keep(author_members(names))
    found = spelt.alias("x").join(spelt.alias("y"), "author").where("x.name < y.name").select(F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b")).distinct()
    found._scratch = scratch
    return found
