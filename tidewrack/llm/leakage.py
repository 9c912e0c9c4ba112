"""Evaluation texts leaking into training text.

All test items are normalised and cut into word n-grams, which make the patterns
of one Aho-Corasick automaton; every document is normalised the same way, with
the offset of each word in the original kept, and scanned once. Matched n-grams
that run in step with an item form a passage; small gaps in it (a word changed,
dropped or added) are bridged. An item leaks where at most two passages of a
document hold the asked share of its words.

Items made from one mould share n-grams, so a passage only counts if it also
holds enough of the item's own n-grams, which few other items have. That is counted
over all items, before they are dealt into automata, so the result does not depend
on how many automata there are.

The automaton grows with the held-out items only, never with the corpus; the bytes
of the items are summed before any comes to the driver, and where they are more than
one automaton takes, the items go in blocks, one scan per block.
"""

from __future__ import annotations

import functools
import pickle
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import unicode as U

GRAM = 3
#: Share of the item's words that must stand in the document, and how much of a passage must be the item's own.
SHARE, OWN = 0.4, 0.5
#: n-grams in more than this many items are the mould's, not an item's own.
COMMON = 3
#: Words that may lie between two runs of a passage on either side, and passages that count.
BRIDGE, PLACES = 3, 2
#: A run of words shorter than this is a stray phrase.
SHORTEST = 5
#: Bytes of items in one automaton; more go in blocks, one scan per block.
BLOCK = 16 << 20

_LOOK = str.maketrans(U.LOOKALIKE_FROM, U.LOOKALIKE_TO)
_WORD = re.compile(r"[㐀-鿿぀-ヿ฀-๿]|[^\W_㐀-鿿぀-ヿ฀-๿]+(?:[.,](?=\d)[0-9]+)*")
_FOLD = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "ı": "i"})


def _clean(text: str) -> tuple[str, list[int] | None]:
    """Text with one form per look, and for changed lengths the original offset of every character."""
    if text.isascii():
        return text.lower(), None
    out: list[str] = []
    at: list[int] = []
    for i, char in enumerate(text):
        if char.isascii():
            out.append(char.lower())
            at.append(i)
            continue
        kind = unicodedata.category(char)
        if kind in ("Cf", "Mn"):
            continue
        for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", char).translate(_LOOK).casefold()).translate(_FOLD):
            if not unicodedata.combining(c):
                out.append(c)
                at.append(i)
    return "".join(out), at


def words(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words (characters, for scripts without spaces) and their (start, end) in the original."""
    if not text:
        return [], []
    clean, at = _clean(text)
    found = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(clean)]
    if at is None:
        return [w for w, _, _ in found], [(a, b) for _, a, b in found]
    return [w for w, _, _ in found], [(at[a], at[b - 1] + 1) for _, a, b in found]


def grams(text: str, gram: int = GRAM) -> list[str]:
    """The n-grams of an item as patterns, by their place; of an item shorter than n one of all its words."""
    got = words(text)[0]
    n = min(gram, len(got))
    return [" " + " ".join(got[k : k + n]) + " " for k in range(len(got) - n + 1)] if got else []


class Leaks:
    """The automaton of a block of items and what is needed to judge its matches.

    ``moulds`` are the n-grams that too many items have, of all items; without it they
    are counted over ``items``.
    """

    def __init__(self, items: list[tuple[int, str]], gram: int = GRAM, moulds: frozenset[str] | None = None):
        self.gram = gram
        self.sizes: dict[int, int] = {}
        self.own: dict[int, list[bool]] = {}
        places: dict[str, dict[int, list[int]]] = defaultdict(dict)
        for item, text in items:
            keys = grams(text, gram)
            if not keys:
                continue
            self.sizes[item] = len(words(text)[0])
            for k, key in enumerate(keys):
                places[key].setdefault(item, []).append(k)
        if moulds is None:
            moulds = frozenset(k for k, held in places.items() if len(held) > COMMON)
        self.own = {item: [False] * size for item, size in self.sizes.items()}
        for key, held in places.items():
            if key not in moulds:
                for item, at in held.items():
                    for k in at:
                        self.own[item][k] = True
        # Items that may leak by passages that hold nothing of their own: only these are looked for in moulds alone.
        self.bare = {item for item, size in self.sizes.items() if self._bare(item) >= SHARE * size}
        self.automaton = ahocorasick.Automaton()
        for key, held in places.items():
            bare = {i: at for i, at in held.items() if i in self.bare} if key in moulds else {}
            self.automaton.add_word(key, (key.count(" ") - 1, key in moulds, held, bare))
        if len(self.automaton):
            self.automaton.make_automaton()

    def _bare(self, item: int) -> int:
        """How many words of the item its ``PLACES`` longest rows of n-grams hold that are not its own."""
        rows, now = [], 0
        for own in [*self.own[item][: max(1, self.sizes[item] - self.gram + 1)], True]:
            if own and now:
                rows.append(now + min(self.gram, self.sizes[item]) - 1)
            now = 0 if own else now + 1
        return sum(sorted(rows)[-PLACES:])

    def found(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, share, start, end) of every item that leaks into ``text``, with the span of its largest passage."""
        got, spans = words(text)
        if not got or not len(self.automaton):
            return []
        line = " " + " ".join(got) + " "
        starts, at = {}, 0
        for i, w in enumerate(got):
            starts[at] = i
            at += len(w) + 1
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        moulds: list[tuple[int, int, dict[int, list[int]]]] = []
        for end, (n, mould, held, bare) in self.automaton.iter(line):
            # A pattern ends with the blank after its last word.
            k = starts.get(end)
            first = (len(got) if k is None else k) - n
            if mould:
                moulds.append((first, n, held))
            for item, where in (bare if mould else held).items():
                hits[item] += [(first, place, n) for place in where]
        # Of a mould only the items count that the text has something of; the fewer of the two are gone through.
        named = [i for i in hits if i not in self.bare]
        for first, n, held in moulds:
            for item in named if len(named) < len(held) else [i for i in held if i in hits and i not in self.bare]:
                hits[item] += [(first, place, n) for place in held.get(item, ())]
        out = []
        for item, matched in hits.items():
            size = self.sizes[item]
            if len(matched) + self.gram - 1 < min(SHORTEST, size):
                continue
            passages = self._passages(item, matched)
            covered: set[int] = set()
            for cover, _, _ in passages[:PLACES]:
                covered |= cover
            share = len(covered) / size
            if share >= SHARE:
                _, a, b = passages[0]
                out.append((item, share, spans[a][0], spans[b][1]))
        return out

    def _passages(self, item: int, matched: list[tuple[int, int, int]]) -> list[tuple[set[int], int, int]]:
        """Passages as (item words held, first and last word of the document), the largest first."""
        matched.sort()
        done: list[list] = []
        open_: list[list] = []  # [first, last in text, last in item, words held, own matched, item places matched]
        for first, place, n in matched:
            best = None
            if open_ and any(first - p[1] > BRIDGE + 3 for p in open_):  # nothing can run on in these any more
                done += [p for p in open_ if first - p[1] > BRIDGE + 3]
                open_ = [p for p in open_ if first - p[1] <= BRIDGE + 3]
            for p in open_:
                gap_text, gap_item = first - p[1] - 1, place - p[2] - 1
                if -n <= gap_text <= BRIDGE + 2 and -n <= gap_item <= BRIDGE + 2 and abs(gap_text - gap_item) <= BRIDGE and (best is None or p[1] > best[1]):
                    best = p
            if best is None:
                open_.append([first, first + n - 1, place + n - 1, set(range(place, place + n)), int(self.own[item][place]), place])
                continue
            if place > best[2] + 1:
                best[3].update(range(best[2] + 1, place))
            best[3].update(range(place, place + n))
            best[4] += self.own[item][place]
            best[1], best[2] = max(best[1], first + n - 1), max(best[2], place + n - 1)
        kept = []
        for first, last, _, held, own, _ in done + open_:
            low, high = min(held), max(held)
            asked = sum(self.own[item][low : high - self.gram + 2])
            if (len(held) >= SHORTEST or len(held) == self.sizes[item]) and (own >= OWN * asked and own > 0 or asked == 0):
                kept.append((held, first, last))
        kept.sort(key=lambda p: (-len(p[0]), p[1]))
        return kept


def _moulds(items: DataFrame) -> frozenset[str]:
    """The n-grams that more than ``COMMON`` items have; counted over all items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([k for text in batch.column(0).to_pylist() for k in set(grams(text))], pa.string())], ["gram"])

    held = items.where("text <> ''").groupBy("item").agg(F.min("text").alias("text")).select("text").mapInArrow(cut, "gram string")
    return frozenset(r.gram for r in held.groupBy("gram").count().where(F.col("count") > COMMON).collect())  # at most 1 / COMMON of the items' words


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, share, leak_start, leak_end) of every item that leaks into a document.

    Offsets are code points of the original text. Null and empty texts leak and
    hold nothing; repeated rows of the items change nothing, of the documents they
    repeat; of several texts under one item id the smallest counts. Items are few by nature:
    they come to the driver in blocks of about ``block`` bytes, an automaton each.
    """
    spark = documents.sparkSession
    asked = items.select(F.col(item).alias("item"), "text").where("item is not null and text <> ''").groupBy("item").agg(F.min("text").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    blocks = -(-size // block)
    kinds = documents.schema[key].dataType, items.schema[item].dataType
    schema = f"`{key}` {kinds[0].simpleString()}, `{item}` {kinds[1].simpleString()}, share double, leak_start bigint, leak_end bigint"
    found = spark.createDataFrame([], schema)
    moulds = _moulds(asked) if blocks > 1 else None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()  # some ``block`` bytes
        packed = spark.sparkContext.broadcast(pickle.dumps((sorted(map(tuple, rows)), moulds)))
        part = documents.select(key, text).mapInArrow(_scanner(packed, key, item, items.select(item)), schema)
        found = part if k == 0 else found.unionByName(part)
    return found


@functools.lru_cache(maxsize=2)
def _leaks(packed: bytes) -> Leaks:
    """The automaton of a block, built once in a worker however many tasks it runs."""
    items, moulds = pickle.loads(packed)
    return Leaks(items, moulds=moulds)


def _scanner(packed, key: str, item: str, items: DataFrame):  # noqa: ANN001, ANN202
    kind = pa.int64() if items.schema[item].dataType.simpleString() == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaks = _leaks(packed.value)
        for batch in batches:
            rows, out = [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                for hit in leaks.found(value):
                    rows.append(row)
                    out.append(hit)
            ids, shares, starts, ends = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, kind), pa.array(shares, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [key, item, "share", "leak_start", "leak_end"])

    return run
