"""Several values packed in one field: one row per value, with its position.

Every packed string is reduced to a *delimiter skeleton*: ordinary characters
are masked, repeated parts collapse, and what is left names the delimiters, the
quoting and the shapes of the parts. There are few skeletons however many rows
there are, so the splitting rule is resolved once per distinct skeleton, joined
back by broadcast (behind a check of the count), and applied by position.

Defined results: null, empty and blank fields give no row; empty parts give no
row and no position; a lone value is its own first value; a broken bracket or
quote is ordinary text; a field too odd for any rule comes out as one value.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions import unicode as U
from tidewrack.session import Scratch

#: Broadcast of the rules is only allowed up to this many skeletons; beyond it the join shuffles.
MAX_BROADCAST_SKELETONS = 50_000

# Lower-case parts of surnames, and words of corporate names.
PARTICLES = ("af", "av", "bin", "da", "das", "de", "del", "della", "den", "der", "di", "do", "dos", "du", "el", "la", "le", "ten", "ter", "van", "von", "zu", "zur")
CORPORATE = ("Academy", "Administration", "Agency", "Association", "Authority", "Board", "Bureau", "Center", "Centre", "College", "Commission", "Committee", "Company", "Consortium", "Corporation", "Council", "Department", "Directorate", "Foundation", "Group", "Institute", "Institution", "Laboratory", "Ministry", "Museum", "Network", "Observatory", "Office", "Organisation", "Organization", "Programme", "Program", "Service", "Society", "Survey", "Trust", "University")

_WORD = r"[\p{L}\p{M}\p{N}_.'’`\-‐‑·#@+*:()]+"
_SLASH = r"(?<!\S)/(?!\S)"
_AND = r"(?<!\S)(?:&|and)(?!\S)"
_STRONG = rf"[;；|、\t\n\r]|{_SLASH}"


def skeleton(x: Column, names: bool) -> Column:
    """The delimiter skeleton of ``x``. ``names``: a comma may stand inside a value."""
    t = F.trim(x)
    flags = F.concat(
        F.when(t.rlike(r"(?s)^\[.*\]$"), "[").when(t.rlike(r"(?s)^\{.*\}$"), "{").otherwise(""),
        F.when(t.contains('"'), '"').otherwise(""),
        F.when(t.contains("\\"), "\\").otherwise(""),
    )
    bare = F.regexp_replace(F.regexp_replace(t, r"\\.", "x"), r'"[^"]*"', "x")
    marks = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"({_STRONG}|,|{_AND})"), 1))), "")
    if not names:
        return F.concat(flags, F.lit("#"), marks)
    shape = F.regexp_replace(F.regexp_replace(t, r"\\.", "x"), r'"[^"]*"', "◆")
    shape = F.regexp_replace(shape, r" (?:and|&) ", "＋")
    shape = F.regexp_replace(shape, rf"(?<![\p{{L}}\p{{M}}])(?:{'|'.join(CORPORATE)})(?![\p{{L}}\p{{M}}])", "★")
    shape = F.regexp_replace(shape, rf"(?i)(?<![\p{{L}}\p{{M}}'’-])(?:{'|'.join(PARTICLES)}|of|for|the)(?![\p{{L}}\p{{M}}'’-])", "")
    # A repeated group takes a stack frame of the JVM a turn, and a field may hold thousands of words: only classes are repeated.
    shape = F.regexp_replace(F.regexp_replace(shape, _WORD, "w"), " +", " ")
    shape = F.regexp_replace(shape, r"(?:(?<!w)(?<!w )w[ w]*+)?★[ w★]*+", "O")
    shape = F.regexp_replace(shape, r"(?:w ◆|◆ w)[ w]*+|w w[ w]*+(?:(?<= )◆[ w]*+)?", "W")
    shape = F.regexp_replace(shape, " ", "")
    parts = F.array_join(F.array_sort(F.array_distinct(F.split(shape, _STRONG))), ";")
    parts = F.regexp_replace(F.regexp_replace(parts, r"(,W)\1+", "$1"), r"((?:w,[wW],)+?)\1+", "$1")
    return F.concat(flags, F.lit("#"), marks, F.lit("#"), parts)


def resolve(skeleton: str, names: bool) -> tuple[str, str]:
    """(kind, delimiter pattern) of one skeleton.

    Kinds: ``split`` is a plain split by the pattern; ``tokens`` minds quotes and
    escapes; ``list`` is a bracketed list; ``pairs`` splits by comma and joins
    every surname with the given name after it; ``one`` is a single value.
    """
    flags, _, rest = skeleton.partition("#")
    marks, _, parts = rest.partition("#")
    quoted = '"' in flags or "\\" in flags
    if flags[:1] in ("[", "{"):
        return "list", ","
    strong = [m for m in (";", "；", "|", "、", "\t", "\n", "\r") if m in marks]
    pattern = [re.escape(m) for m in strong] + ([_SLASH] if "/" in marks else [])
    conjunction = "and" in marks or "&" in marks
    comma = "," in marks
    if not names:
        pattern += ([","] if comma else []) + ([_AND] if conjunction else [])
    elif not pattern:
        pieces = re.split("[;＋]", parts)
        if conjunction and "O" in parts:
            pattern.append(rf"(?<!\b(?:of|for) \p{{L}}{{1,40}} ){_AND}")  # "Institute of Marine and Coastal ..." is one name
        elif conjunction:
            pattern.append(_AND)
        fields = [f for p in pieces for f in p.split(",") if f]
        if comma and any("," in p for p in pieces):
            if all(f[0] in "WO◆" for f in fields):
                pattern.append(",")
            elif not quoted and "W" in fields and all(f[0] in "WO" or (f == "w" and g[0] == "O") for p in pieces for g, f in _neighbours(p)):
                pattern.append(r",(?! *[^\s,]+ *(?:,|$))")  # the seat of a corporate author stays with it
            elif not conjunction and len(pieces) == 1 and len(fields) > 2 and len(fields) % 2 == 0 and all(f == "w" for f in fields[::2]):
                return "pairs", ","
            elif quoted and all(f[0] in "WO◆w" for f in fields) and any(f[0] == "◆" for f in fields):
                pattern.append(",")
    if not pattern:
        return ("tokens", "(?!)") if quoted else ("one", "")
    return ("tokens" if quoted else "split"), "|".join(pattern)


def _neighbours(piece: str) -> Iterator[tuple[str, str]]:
    """The non-empty fields between the commas of a piece, each after the one before it."""
    fields = [f for f in piece.split(",") if f]
    return zip([" ", *fields], fields)


def _unquote(part: str) -> str:
    part = part.strip()
    if len(part) >= 2 and part[0] == '"' and part[-1] == '"':
        inner = part[1:-1]
        if '"' not in inner.replace('""', "").replace('\\"', ""):
            part = inner.replace('""', '"')
    return re.sub(r"\\(.)", r"\1", part, flags=re.S).strip()


def _tokens(text: str, pattern: str) -> list[str]:
    """Parts between delimiters that stand outside quotes and escapes.

    A quote opens only where a part begins and closes only before a delimiter or
    the end, so quotes inside a name stay.
    """
    delimiter = regex.compile(pattern)
    parts, start, at = [], 0, 0
    fresh = True
    while at < len(text):
        char = text[at]
        if char == "\\":
            at, fresh = at + 2, False
            continue
        if char == '"' and fresh:
            end = at + 1
            while True:
                end = text.find('"', end)
                if end < 0:
                    break
                if text[end - 1] == "\\" or text[end + 1 : end + 2] == '"':
                    end += 1 if text[end - 1] == "\\" else 2
                    continue
                rest = text[end + 1 :].lstrip(" ")
                if not rest or delimiter.match(text, end + 1) or delimiter.match(rest):
                    break
                end += 1
            at, fresh = (end + 1, False) if end > 0 else (at + 1, False)
            continue
        found = delimiter.match(text, at)
        if found and found.end() > at:
            parts.append(text[start:at])
            start = at = found.end()
            fresh = True
            continue
        fresh = fresh and char == " "
        at += 1
    parts.append(text[start:])
    return [_unquote(p) for p in parts]


def _whole(text: str) -> str:
    """Escaped halves of a character joined; a half without the other, which no column can hold, is U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _listed(text: str) -> list[str]:
    for read in (json.loads, ast.literal_eval) if text[:1] == "[" else ():
        try:
            got = read(text)
            return [_whole(v.strip() if isinstance(v, str) else str(v)) for v in got if v is not None]
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    inner = text[1:-1]
    parts = _tokens(inner, ",")
    if text[:1] == "[":
        parts = [p[1:-1] if len(p) > 1 and p[0] == p[-1] == "'" else p for p in parts]
    return parts


def unpack(text: str | None, kind: str | None, pattern: str | None) -> list[str]:
    """The non-empty values of one packed string under its rule."""
    if text is None:
        return []
    text = text.strip()
    if kind == "list":
        parts = _listed(text)
    elif kind == "tokens":
        parts = _tokens(text, pattern)
    elif kind == "pairs":
        bits = [b for b in map(str.strip, text.split(",")) if b]
        parts = [", ".join(bits[i : i + 2]) for i in range(0, len(bits), 2)]
    else:
        parts = [text]
    return [q for p in parts if (q := p.strip())]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unpack_udf(text: pd.Series, kind: pd.Series, pattern: pd.Series) -> pd.Series:
    return pd.Series([unpack(t, k, p) for t, k, p in zip(text, kind, pattern)], dtype=object)


def split_values(df: DataFrame, key: Column, fields: dict[str, bool]) -> DataFrame:
    """(field_name, record_key, value_pos, value) of the packed ``fields`` of ``df``.

    ``fields`` maps a column to whether it holds names of people (in which a comma
    may belong to the value). Rows repeated exactly count once; a value repeated
    within its field stays. Rows with a null key come out under a null key.
    Extra columns of ``df``, whatever their names, are not read.
    """
    packed = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.lit(n).alias("names"), F.col(f"`{c}`").cast("string").alias("packed")) for c, n in fields.items()]))
    long = df.select(key.alias("record_key"), packed.alias("f")).select("record_key", "f.field_name", "f.names", F.regexp_replace("f.packed", "\\A[\\s\\u00a0]+|[\\s\\u00a0]+\\z", "").alias("packed"))
    long = long.where("packed is not null and packed <> ''")
    cut = [F.when(F.col("names"), skeleton(F.col("packed"), True)).otherwise(skeleton(F.col("packed"), False)).alias("skeleton")]
    long = long.withColumn("skeleton", cut[0])
    # A hash of every row's skeleton keeps the same few rows together before they are counted.
    rules = long.groupBy("names", "skeleton").agg(F.count("*").alias("rows")).mapInPandas(_rules, "names boolean, skeleton string, kind string, pattern string")
    scratch = Scratch(df.sparkSession, "rules")
    rules = scratch.keep(rules)
    ruled = long.join(F.broadcast(rules) if rules.measured["rows"] <= MAX_BROADCAST_SKELETONS else rules, ["names", "skeleton"])
    plain = F.split(F.col("packed"), F.col("pattern"))
    rich = _unpack_udf(F.when(F.col("kind") != "split", F.col("packed")), F.col("kind"), F.col("pattern"))
    values = F.when(F.col("kind") == "split", F.filter(F.transform(plain, lambda v: F.regexp_replace(v, "\\A[\\s\\u00a0]+|[\\s\\u00a0]+\\z", "")), lambda v: v != "")).otherwise(rich)
    out = ruled.select("field_name", "record_key", F.posexplode(values).alias("at", "value"))
    out = out.select("field_name", "record_key", (F.col("at") + 1).cast("int").alias("value_pos"), "value").distinct()
    out._scratch = scratch
    return out


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        got = [resolve(s, bool(n)) for s, n in zip(batch["skeleton"], batch["names"])]
        yield pd.DataFrame({"names": batch["names"], "skeleton": batch["skeleton"], "kind": [k for k, _ in got], "pattern": [p for _, p in got]})

