"""Boolean and proximity text search: four query dialects compiled to Column predicates.

AND, OR, NOT, quoted phrases, a trailing ``*`` and ``NEAR/n``; ``+`` and ``|`` are
AND and OR of the second dialect; words side by side are joined by AND. The
``stemmed`` dialect knows no ``*`` and lets any word ending follow; the web dialect
has ``filetype:`` and a list of domains. Predicates are built-in expressions, so they
run in the scan's stage. Words are runs of letters and digits of any script.

The eight query families are groups of terms; ``family_query`` says one in any dialect.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions.unicode import let

_TOKEN = re.compile(r'\s*(?:(\(|\))|"([^"]*)"|NEAR/(\d+)|(\+|\||-(?=\S))|([^\s()"|+]+))')
_W = r"[\p{L}\p{N}]"
_N = r"[^\p{L}\p{N}]"


@dataclass(frozen=True)
class Query:
    """A parsed query: ``op`` is term, and, or, not or near."""

    op: str
    parts: tuple = ()
    text: str = ""
    distance: int = 0


def parse(text: str) -> Query:
    """The query as a tree. Field tags such as ``TS=`` are skipped; an unclosed bracket ends with the text."""
    text = re.sub(r"\b[A-Z]{2}=", "", text)
    tokens: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(text):
        bracket, phrase, near, sign, word = m.groups()
        if bracket:
            tokens.append((bracket, bracket))
        elif phrase is not None:
            tokens.append(("term", phrase))
        elif near:
            tokens.append(("near", near))
        elif sign:
            tokens.append(({"+": "and", "|": "or", "-": "not"}[sign], sign))
        elif word:
            tokens.append((word.lower(), word) if word in ("AND", "OR", "NOT") else ("term", word))
    at = 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def either() -> Query:
        nonlocal at
        parts = [both()]
        while peek() == "or":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Query("or", tuple(parts))

    def both() -> Query:
        nonlocal at
        parts = [close()]
        while peek() in ("and", "term", "(", "not"):
            at += peek() == "and"
            parts.append(close())
        return parts[0] if len(parts) == 1 else Query("and", tuple(parts))

    def close() -> Query:
        nonlocal at
        left = one()
        while peek() == "near":
            n = int(tokens[at][1])
            at += 1
            left = Query("near", (left, one()), distance=n)
        return left

    def one() -> Query:
        nonlocal at
        kind = peek()
        if kind == "not":
            at += 1
            return Query("not", (one(),))
        if kind == "(":
            at += 1
            inner = either()
            at += peek() == ")"
            return inner
        if not kind:
            return Query("term")
        at += 1
        return Query("term", text=tokens[at - 1][1])

    return either()


def _words(term: str, stemmed: bool) -> list[str]:
    """A pattern for each word of a term."""
    words = re.findall(r"[^\W_]+\*?", term.lower())
    return [re.escape(w.rstrip("*")) + (f"{_W}*" if stemmed or w.endswith("*") else "") for w in words]


def terms(query: Query) -> list[str]:
    """The terms of a query."""
    return [query.text] if query.op == "term" else [t for p in query.parts for t in terms(p)]


def matches(query: Query | str, text: Column, stemmed: bool = False) -> Column:
    """Whether ``text`` matches; null text matches nothing, an empty term everything."""
    query = parse(query) if isinstance(query, str) else query
    low = F.lower(F.coalesce(text, F.lit("")))
    if query.op == "term":
        words = _words(query.text, stemmed)
        return low.rlike(rf"(^|{_N}){f'{_N}+'.join(words)}($|{_N})") if words else F.lit(True)
    if query.op == "not":
        return ~matches(query.parts[0], text, stemmed)
    if query.op == "near":
        return near(query, text, stemmed)
    parts = [matches(p, text, stemmed) for p in query.parts]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query.op == "and" else (out | p)
    return out


def near(query: Query, text: Column, stemmed: bool = False) -> Column:
    """Whether the one side stands within so many words of the other, counted between whole phrases.

    An AND on a side asks for each of its parts near the other side, an OR for any of
    them; a NOT asks that its part is not near what the other side matches.
    """
    left, right = query.parts
    for side, other in ((left, right), (right, left)):
        if side.op == "and":
            out = F.lit(True)
            for p in side.parts:
                out = out & near(Query("near", (p, other), distance=query.distance), text, stemmed)
            return out
        if side.op == "not":
            return matches(other, text, stemmed) & ~near(Query("near", (side.parts[0], other), distance=query.distance), text, stemmed)
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{_N}+", " ")), " ")
    return let(words, lambda w: let(_spans(left, w, stemmed), lambda a: let(_spans(right, w, stemmed), lambda b: F.exists(a, lambda i: F.exists(b, lambda j: _apart(i, j) <= query.distance)))))


def _apart(i: Column, j: Column) -> Column:
    """How many words on the one span begins after the other's end; nought or less where they overlap."""
    return F.greatest(j["first"] - i["last"], i["first"] - j["last"])


def _spans(side: Query, words: Column, stemmed: bool) -> Column:
    """(first, last) places of what a side of NEAR matches: phrases, any of several, or a nested NEAR as a whole."""
    if side.op == "term":
        patterns = _words(side.text, stemmed)
        n = len(patterns)
        if not n:
            return F.transform(words, lambda w, i: F.struct(i.alias("first"), i.alias("last")))
        hit = lambda w, i: reduce(lambda x, y: x & y, [F.coalesce(F.get(words, i + k).rlike(f"^(?:{p})$"), F.lit(False)) for k, p in enumerate(patterns)])
        return F.filter(F.transform(words, lambda w, i: F.when(hit(w, i), F.struct(i.alias("first"), (i + n - 1).alias("last")))), lambda s: s.isNotNull())
    parts = [_spans(p, words, stemmed) for p in side.parts]
    if side.op == "near":
        both = lambda i, j: F.when(_apart(i, j) <= side.distance, F.struct(F.least(i["first"], j["first"]).alias("first"), F.greatest(i["last"], j["last"]).alias("last")))
        return F.filter(F.flatten(F.transform(parts[0], lambda i: F.transform(parts[1], lambda j: both(i, j)))), lambda s: s.isNotNull())
    if side.op == "or":
        return F.concat(*parts)
    raise ValueError(f"{side.op} inside a nested NEAR")


def on_web(query: str, text: Column, url: Column, domains: tuple[str, ...] = (), stemmed: bool = False) -> Column:
    """The web dialect: a boolean query with ``filetype:x`` (the address ends in it) and a list of domains (or their subdomains)."""
    kinds = re.findall(r"(?i)\bfiletype:(\w+)", query)
    found = matches(re.sub(r"(?i)\bfiletype:\w+", " ", query), text, stemmed)
    path = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", ""))
    for kind in kinds:
        found = found & path.endswith("." + kind.lower())
    if domains:
        host = F.regexp_extract(path, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:]+)", 1)
        found = found & reduce(lambda x, y: x | y, [(host == d.lower()) | host.endswith("." + d.lower()) for d in domains])
    return found


# The groups of terms of the eight query families.
CORAL = ("coral*", "octocoral*", "gorgonian*", "sea pen*", "pennatula*", "scleractinian*", "antipatharian*", "black coral*")
SPONGE = ("Porifera", "poriferan*", "demosponge*", "hexactinellid*", "glass sponge*", "deep-sea sponge*", "deep sea sponge*", "cold-water sponge*", "cold water sponge*")
FAMILIES = {
    "SED_SUSPENDED": (CORAL + SPONGE, ("suspended sediment*", "suspended solid*", "suspended particle*", "turbidity", "resuspension", "particle concentration*", "sediment plume*")),
    "SED_DEPOSITION": (CORAL + SPONGE, ("sediment deposition", "sediment accumulation", "sediment load*", "burial", "smother*", "sediment cover*", "sediment thickness", "deposition rate*")),
    "SED_DRILLING": (CORAL + SPONGE, ("drill cutting*", "drilling mud*", "drilling fluid*", "drilling discharge*", "drilling waste*", "cuttings pile*", (("offshore drilling",), ("sediment*", "bentonite", "barite", "particulate*", "discharge*")))),
    "SED_DREDGING": (CORAL + SPONGE, ("dredg*", "dredge plume*", "dredging plume*", "resuspension", "resuspended sediment*", "sediment plume*", "spoil disposal", "dredged material")),
    "SED_TAILINGS": (CORAL + SPONGE, ("mine tailing*", "mining tailing*", "submarine tailing*", "deep-sea mining", "deep sea mining", "seafloor massive sulphide*", "seafloor massive sulfide*", "mining plume*", "marine disposal", "particulate waste*")),
    "MECH_FEEDING_MUCUS_CORAL": (CORAL, ("sediment*", "turbidity", "suspended solid*", "suspended particle*", "burial", "smother*", "bentonite", "barite", "drill cutting*"), ("mucus", "mucous", "mucociliary", "sediment rejection", "sediment clearance", "particle rejection", "feeding", "food capture", "prey capture", "polyp activity", "tentacle activity")),
    "MECH_FEEDING_PUMPING_SPONGE": (SPONGE, ("sediment*", "turbidity", "suspended solid*", "suspended particle*", "bentonite", "barite", "drill cutting*"), ("pumping", "filtration", "feeding current*", "food capture", "clogging", "particle clearance", "clearance rate*")),
    "RESP_THRESHOLD_RECOVERY": (CORAL + SPONGE, ("suspended sediment*", "sediment deposition", "sediment accumulation", "sediment load*", "turbidity", "burial", "smother*", "drill cutting*", "drilling mud*", "drilling discharge*", "resuspended sediment*", "sediment plume*"), ("threshold*", "tolerance", "sensitiv*", "dose-response", "dose response", "exposure-response", "exposure response", "recovery", "mortality", "survival", "chronic exposure", "acute exposure")),
}
#: The family whose last two groups stand near each other, and how near.
NEAR_FAMILY, NEAR_WORDS = "RESP_THRESHOLD_RECOVERY", 10


def family_query(family: str, dialect: str = "wos") -> str:
    """A family in a dialect: ``wos``, ``scholar`` (NEAR becomes AND), ``stemmed`` (no ``*``) or ``web``."""
    and_, or_ = {"scholar": (" + ", " | "), "web": (" ", " OR ")}.get(dialect, (" AND ", " OR "))

    def said(term) -> str:  # noqa: ANN001
        if isinstance(term, tuple):
            return "(" + and_.join(group(g) for g in term) + ")"
        term = term.replace("*", "") if dialect == "stemmed" else term
        return f'"{term}"' if re.search(r"[\s-]", term) else term

    def group(ts: tuple) -> str:
        return "(" + or_.join(said(t) for t in ts) + ")"

    groups = [group(g) for g in FAMILIES[family]]
    if family == NEAR_FAMILY and dialect == "wos":
        groups[1:] = [f"({groups[1]} NEAR/{NEAR_WORDS} {groups[2]})"]
    text = and_.join(groups)
    return f"TS=({text})" if dialect == "wos" else text
