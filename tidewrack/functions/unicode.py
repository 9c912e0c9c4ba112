"""Character tables, built by rule from the Unicode database, for JVM-side ``translate``."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alikes of Latin letters in Cyrillic and Greek.
LOOKALIKE_FROM = "АВЕЅІЈКМНОРСТУХЅԌԚԜҮаеѕіјорсухһԁԛԝҽѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳІі"
LOOKALIKE_TO = "ABESIJKMHOPCTYXSGQWYaesijopcyxhdqwevABEZHIKMNOPTYXovjIi"

# Letters whose base letter the Unicode database does not give.
LETTERS_WITHOUT_DECOMPOSITION = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H", "ı": "i",
    "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ẞ": "SS", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D",
}

#: Characters that show nothing: format characters, soft hyphen, variation selectors, controls but line ends.
INVISIBLE = r"[\p{Cf}͏ᅟᅠ឴឵︀-️]|[\p{Cc}&&[^\t\n\r\u000b\u000c\u0085]]"
#: Every kind of blank.
BLANKS = r"[\p{Z}\t\n\r\u000b\u000c\u0085]+"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often the body names it."""
    return F.transform(F.array(x), body)[0]


def beyond_ascii(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of texts with any character beyond ASCII; others, most of them, stay as they are."""
    return let(x, lambda v: F.when(F.octet_length(v) > F.length(v), body(v)).otherwise(v))


@functools.cache
def compatibility_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility characters: one-to-one ``translate`` strings and the few that expand.

    Accents stay: of the canonical decompositions only those into one character are
    in. Blanks are handled apart.
    """
    source, target, expanding = [], [], []
    for code in range(0xA0, 0x20000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if unicodedata.category(char) in ("Zs", "Cf", "Cn"):
            continue
        plain = unicodedata.normalize("NFKC", char)
        kind = unicodedata.decomposition(char)
        if plain == char or not (kind.startswith("<") or (kind and " " not in kind)):
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif unicodedata.category(char).startswith("L") and plain.isascii() and plain.isalpha():
            expanding.append((char, plain))
    return "".join(source), "".join(target), tuple(expanding)


@functools.cache
def accent_tables() -> tuple[str, str]:
    """Letters with accents and their base letters, one to one."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    for char, base in LETTERS_WITHOUT_DECOMPOSITION.items():
        if len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def compatibility(x: Column) -> Column:
    """Full-width, styled and ligature characters to their ordinary ones."""
    source, target, expanding = compatibility_tables()
    x = F.translate(x, source, target)
    ligatures = "".join(a for a, _ in expanding)

    def expanded(x: Column) -> Column:
        once = x
        for char, plain in expanding:
            once = F.replace(once, F.lit(char), F.lit(plain))
        return F.when(x.rlike(f"[{ligatures}]"), once).otherwise(x)

    return let(x, expanded)


def lookalikes(x: Column) -> Column:
    """Cyrillic and Greek letters that look Latin to the Latin ones."""
    return F.translate(x, LOOKALIKE_FROM, LOOKALIKE_TO)


def visible(x: Column) -> Column:
    """Text without characters that show nothing."""
    return F.regexp_replace(x, INVISIBLE, "")


def squeeze(x: Column) -> Column:
    """Runs of any blank become one space; outer blanks go."""
    return F.trim(F.regexp_replace(x, BLANKS, " "))


def without_accents(x: Column) -> Column:
    """Base letters: combining marks of Latin, Greek and Cyrillic go, accented letters lose theirs."""
    source, target = accent_tables()
    x = F.translate(F.regexp_replace(x, r"[̀-ͯ]", ""), source, target)
    for char, base in LETTERS_WITHOUT_DECOMPOSITION.items():
        if len(base) > 1:
            x = F.replace(x, F.lit(char), F.lit(base))
    return x


#: Letters of either case that fold to one Latin letter, for keys that ignore case.
FOLD_FROM = "авекмнорстухіјѕһԁԛԝοαβεζηικμνρτυχ"
FOLD_TO = "abekmhopctyxijshdqwoabezhikmnptyx"


def folded_lookalikes(x: Column) -> Column:
    """Look-alikes folded after lower-casing, alike for both cases of a letter.

    Native Cyrillic and Greek words turn into mixed ones, but always the same, so
    equality of keys is kept whatever the case.
    """
    return F.translate(F.lower(x), FOLD_FROM, FOLD_TO)
