"""Four-pass constrained entity resolution with survivorship and provenance.

Records join by DOI, exact title, address and similar title; two clusters with
different DOIs never join, and each refusal is a conflict. The first two passes
have a closed form of pre-aggregated minima. In the third the order of the buckets
decides, but only for clusters with several addresses: those, with the first cluster
and the first DOI of each address, are replayed in that order, and all others, however
many share one page, follow from these by a join. The fourth compares cluster
representatives within blocks of two leading words.

Every union leaves an edge with its reason; the edges give the basis of each
occurrence and cluster.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import text as X
from tidewrack.operators.graph import smallest_members
from tidewrack.session import Scratch, spread

# Priority of systems, and thresholds of the similar-title pass.
PRIORITY = {"OpenAlex": 4, "Citation chaining": 4, "Semantic Scholar": 3, "Web of Science": 2, "Grey literature": 1, "Benchmark remediation": 1}
STATUSES = ("ARCHIVED", "OPEN_ACCESS_PDF", "OPEN_ACCESS_LANDING_PAGE", "LIKELY_FULL_DOCUMENT_URL", "NOT_IDENTIFIED")
REVIEW_RATIO, REVIEW_JACCARD = 0.88, 0.80
SAME_AUTHOR, NEAR_IDENTICAL = (0.965, 0.88), (0.985, 0.94)
#: Titles of a block that one task compares with as many others, how many of these at once, and an index after all others.
PART, TILE, NEVER = 4000, 200, 2**62
#: Bits, in words of 64, that stand for the words of a title.
SIGNS = 4
#: Letters up to which titles are compared all at once.
SHORT = 512
#: Words up to which titles meet on three words at once.
LONG = 50


def priority(system: Column) -> Column:
    return F.coalesce(*[F.when(system == s, p) for s, p in PRIORITY.items()], F.lit(0))


def finalize(df: DataFrame) -> DataFrame:
    """Occurrences with cleaned fields and the derived ``norm_title``, ``canonical_url`` and ``author1``."""
    derived = df.select("*", X.normalize_title(F.col("title")).alias("norm_title"), X.normalize_url(F.col("url")).alias("canonical_url"), X.first_author(F.col("authors")).alias("author1"))
    return derived.withColumns({"title": X.clean_space(F.col("title")), "authors": X.clean_space(F.col("authors")), "year": X.normalize_year(F.col("year"), F.col("publication_date")), "doi": X.normalize_doi(F.col("doi")), "url": X.clean_space(F.col("url")), "abstract_or_snippet": F.substring(X.clean_space(F.col("abstract_or_snippet")), 1, 8000)})


def exact_clusters(df: DataFrame, idx: str = "occ_idx", least: int = 15) -> DataFrame:
    """(idx, cluster, reason): clusters after the DOI and exact-title passes.

    A cluster is named by the first record of its DOI, or of its title where it has none.

    In a title bucket the first record is the anchor; records whose year agrees with
    it take part. Those without a DOI join the cluster of the bucket's first DOI, or
    of the anchor where there is none.
    """
    by_doi = df.where("doi <> ''").groupBy("doi").agg(F.min(idx).alias("doi_first"))
    keyed = df.select(idx, "doi", "year", "norm_title").join(by_doi, "doi", "left")
    long = keyed.where(F.length("norm_title") >= least)
    anchor = long.groupBy("norm_title").agg(F.min(F.struct(idx, "year")).alias("a"))
    members = long.join(anchor, "norm_title").where(X.compatible_year(F.col("a.year"), F.col("year")))
    chosen = members.groupBy("norm_title").agg(F.min(F.when(F.col("doi") != "", F.struct(idx, "doi_first"))).alias("d"), F.count("*").alias("n"))
    joined = members.where("doi = ''").join(chosen.where("n > 1"), "norm_title").select(idx, F.coalesce("d.doi_first", f"a.{idx}").alias("title_cluster"))
    out = keyed.join(joined, idx, "left")
    return out.select(idx, F.coalesce("doi_first", "title_cluster", idx).alias("cluster"), F.when(F.col("doi_first").isNotNull(), "DOI").when(F.col("title_cluster").isNotNull(), "EXACT_TITLE_YEAR").otherwise("SINGLETON").alias("reason"))


def _title_buckets(df: DataFrame, idx: str, least: int) -> DataFrame:
    """Members of every title bucket that take part, with the anchor and the bucket's first DOI: idx, norm_title, doi, title, a, d."""
    long = df.where(F.length("norm_title") >= least).select(idx, "doi", "year", "norm_title", "title")
    anchor = long.groupBy("norm_title").agg(F.min(F.struct(idx, "year", "doi", "title")).alias("a"), F.count("*").alias("n")).where("n > 1")
    members = long.join(anchor, "norm_title").where(X.compatible_year(F.col("a.year"), F.col("year")))
    first = members.groupBy("norm_title").agg(F.min(F.when(F.col("doi") != "", F.struct(idx, "doi"))).alias("d"))
    return members.join(first, "norm_title").select(idx, "norm_title", "doi", "title", "a", "d")


def exact_edges(df: DataFrame, idx: str = "occ_idx", least: int = 15) -> DataFrame:
    """(a, b, reason): the unions of the DOI and exact-title passes."""
    first = df.where("doi <> ''").groupBy("doi").agg(F.min(idx).alias("a"))
    by_doi = df.where("doi <> ''").select("doi", F.col(idx).alias("b")).join(first, "doi").where("a <> b").select("a", "b", F.lit("DOI").alias("reason"))
    bucket = _title_buckets(df, idx, least)
    joins = (F.col("doi") == "") | ((F.col("a.doi") == "") & (F.col(idx) == F.col(f"d.{idx}")))
    by_title = bucket.where(joins & (F.col(idx) != F.col(f"a.{idx}"))).select(F.col(f"a.{idx}").alias("a"), F.col(idx).alias("b"), F.lit("EXACT_TITLE_YEAR").alias("reason"))
    return by_doi.unionByName(by_title)


def title_conflicts(df: DataFrame, idx: str = "occ_idx", least: int = 15) -> DataFrame:
    """Refusals of the exact-title pass: members whose DOI is not the bucket's first; those whose year does not agree take no part."""
    rows = _title_buckets(df, idx, least).where("doi <> '' and doi <> d.doi")
    return rows.select(F.col("norm_title").alias("match_key"), F.lit("EXACT_TITLE_YEAR").alias("reason"), F.col("d.doi").alias("left_dois"), F.col("doi").alias("right_dois"), F.col("a.title").alias("left_title"), F.col("title").alias("right_title")).distinct()


_UNIONS = "what string, cluster long, joined long, a long, b long, canonical_url string, left_doi string, right_doi string"


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """Join clusters of one component by address, in bucket order, refusing unlike DOIs."""
    root = {c: c for c in pdf["cluster"].tolist()}
    dois = dict(zip(pdf["cluster"].tolist(), pdf["doi"]))
    rows = []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    buckets: dict[str, list[tuple[int, int]]] = {}
    for i, c, u in sorted(zip(pdf["idx"].tolist(), pdf["cluster"].tolist(), pdf["canonical_url"])):
        buckets.setdefault(u, []).append((i, c))
    for url, ((at, anchor), *others) in buckets.items():
        for i, other in others:
            a, b = find(anchor), find(other)
            if a == b:
                continue
            if dois[a] and dois[b] and dois[a] != dois[b]:
                rows.append(("conflict", other, None, at, i, url, dois[a], dois[b]))
                continue
            low, high = min(a, b), max(a, b)
            root[high], dois[low] = low, dois[a] or dois[b]
            rows.append(("edge", None, None, at, i, url, None, None))
    rows += [("join", c, find(c), None, None, None, None, dois[find(c)]) for c in root]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _UNIONS.split(", ")])


def url_unions(df: DataFrame, clusters: DataFrame, idx: str = "occ_idx") -> DataFrame:
    """What the address pass does: rows of kind join (cluster to joined), edge (a, b) and conflict (cluster refused at an address).

    Of an address, only its first cluster, its first cluster with a DOI and those that
    have another shared address too bear on anything else; components of these are
    replayed, one task each. Any other cluster joins the first one if it has no DOI,
    and is refused if it has one.
    """
    scratch = Scratch(df.sparkSession, "addresses")
    rows = df.select(idx, "canonical_url", "doi").join(clusters.select(idx, "cluster"), idx)
    doi = rows.groupBy("cluster").agg(F.max("doi").alias("doi"))
    known = rows.where("canonical_url <> ''").groupBy("cluster", "canonical_url").agg(F.min(idx).alias("idx")).join(doi, "cluster")
    per_url = known.groupBy("canonical_url").agg(F.min(F.struct("idx", "cluster")).alias("first"), F.min(F.when(F.col("doi") != "", F.struct("idx", "cluster"))).alias("with_doi"), F.count("*").alias("n")).where("n > 1")
    shared = known.join(per_url, "canonical_url")
    urls = shared.groupBy("cluster").agg(F.count("*").alias("urls"))
    shared = scratch.keep(shared.join(urls, "cluster"))
    core = (F.col("cluster") == F.col("first.cluster")) | (F.col("urls") > 1) | F.coalesce(F.col("cluster") == F.col("with_doi.cluster"), F.lit(False))
    reach = smallest_members(shared.where(core).select(F.col("cluster").alias("a"), F.col("first.cluster").alias("b")))
    work = shared.where(core).select("cluster", "canonical_url", "idx", "doi").join(reach.withColumnRenamed("node", "cluster"), "cluster")
    done = scratch.keep(spread(work, "component").groupBy("component").applyInPandas(lambda pdf: _replay(pdf), _UNIONS))
    state = done.where("what = 'join'").select(F.col("cluster").alias("first_cluster"), "joined", F.col("right_doi").alias("held"))
    rest = shared.where(~core).withColumn("first_cluster", F.col("first.cluster")).join(state, "first_cluster")
    free = F.col("doi") == ""
    null = lambda kind: F.lit(None).cast(kind)
    joins = rest.select(F.lit("join").alias("what"), "cluster", F.when(free, F.col("joined")).otherwise(F.col("cluster")).alias("joined"), null("long").alias("a"), null("long").alias("b"), null("string").alias("canonical_url"), null("string").alias("left_doi"), F.col("held").alias("right_doi"))
    edges = rest.where(free).select(F.lit("edge").alias("what"), null("long").alias("cluster"), null("long").alias("joined"), F.col("first.idx").alias("a"), F.col("idx").alias("b"), "canonical_url", null("string").alias("left_doi"), null("string").alias("right_doi"))
    refused = rest.where(~free).select(F.lit("conflict").alias("what"), "cluster", null("long").alias("joined"), F.col("first.idx").alias("a"), F.col("idx").alias("b"), "canonical_url", F.col("held").alias("left_doi"), F.col("doi").alias("right_doi"))
    out = done.unionByName(joins).unionByName(edges).unionByName(refused)
    out._scratch = (scratch, reach)
    return out


def url_clusters(df: DataFrame, clusters: DataFrame, idx: str = "occ_idx") -> DataFrame:
    """(cluster, joined): clusters that an address joins."""
    unions = url_unions(df, clusters, idx)
    out = unions.where("what = 'join'").select("cluster", "joined")
    out._scratch = unions
    return out


def url_conflicts(df: DataFrame, clusters: DataFrame, unions: DataFrame, idx: str = "occ_idx") -> DataFrame:
    """Refusals of the address pass: every title of a refused cluster at the address, against the first record's."""
    rows = df.where("canonical_url <> ''").select(idx, "canonical_url", "title").join(clusters.select(idx, "cluster"), idx)
    titles = rows.groupBy("cluster", "canonical_url", "title").agg(F.min(idx).alias("i"))
    refused = unions.where("what = 'conflict'").select("cluster", "canonical_url", "a", "left_doi", "right_doi")
    left = df.select(F.col(idx).alias("a"), F.col("title").alias("left_title"))
    out = refused.join(titles, ["cluster", "canonical_url"]).join(left, "a")
    return out.select(F.col("canonical_url").alias("match_key"), F.lit("CANONICAL_URL").alias("reason"), F.col("left_doi").alias("left_dois"), F.col("right_doi").alias("right_dois"), "left_title", F.col("title").alias("right_title")).distinct()


def block_key(title: Column) -> Column:
    return F.substring(F.array_join(F.slice(F.split(title, " "), 1, 2), " "), 1, 28)


def representatives(df: DataFrame, clusters: DataFrame, idx: str = "occ_idx") -> DataFrame:
    """One row per cluster: its first record, its DOI, and the record whose title stands for it, with that record's fields."""
    best = F.max(F.struct(priority(F.col("system")).alias("p"), F.length("title").alias("l"), F.negative(idx).alias("n"), "norm_title", "year", "author1"))
    found = df.join(clusters.select(idx, "cluster"), idx).groupBy("cluster").agg(best.alias("b"), F.max("doi").alias("doi"), F.min(idx).alias("first"))
    return found.select("cluster", "first", (-F.col("b.n")).alias(idx), "b.p", "b.l", "b.norm_title", "b.year", "b.author1", "doi")


def _words(titles: DataFrame) -> DataFrame:
    return titles.where(F.length("norm_title") >= 20).withColumn("block", block_key(F.col("norm_title"))).withColumn("words", F.array_distinct(F.split("norm_title", " ")))


def _meeting(words: Column, n: Column, share: float) -> Column:
    """Hashes of the words on which a title meets all others with ``share`` of common words, from its ``words``, rarest first.

    Two titles with o common words, o >= ceil(share * n) for both, hold the first three of
    these among their first n - o + 3. Titles of one or two words only meet
    those of as many. Long titles, which have many sets of three, meet on the first word alone; either side
    of the bound is within reach of the other, so those near it do both.
    """
    most = n - F.ceil(n * share - 1e-9)
    by_three = F.slice(words, 1, (most + 3).cast("int"))
    later = lambda k: F.slice(by_three, k, F.size(by_three))
    threes = F.flatten(F.transform(by_three, lambda a, i: F.flatten(F.transform(later(i + 2), lambda b, j: F.transform(later(i + j + 3), lambda c: F.xxhash64(a, b, c))))))
    first = F.transform(F.slice(words, 1, (most + 1).cast("int")), lambda a: F.xxhash64(a))
    none = F.array().cast("array<bigint>")
    return F.when(n < 3, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.concat(F.when(n <= LONG, threes).otherwise(none), F.when(n >= LONG * share, first).otherwise(none)))


def _overlapping(one: DataFrame, idx: str, share: float = REVIEW_JACCARD) -> DataFrame:
    """(l_, r_, jaccard): pairs of one block with ``share`` of common words or more, l_ < r_.

    They meet on the rarest words of the block (``_meeting``). What travels for each of these is not the
    words but ``SIGNS`` times 64 bits, one bit for each word: every bit that only one title has is a word that
    the other lacks, which bounds what they have in common. Few that fail pass it, and those are compared as texts.
    """
    words = one.select(idx, "block", F.size("words").alias("n"), F.explode("words").alias("word"))
    counts = words.groupBy("block", "word").agg(F.count("*").alias("held"))
    order = F.array_sort(F.collect_list(F.struct("held", "word")))
    rare = words.join(counts, ["block", "word"]).groupBy(idx, "block", "n").agg(order.alias("order"))
    named = F.transform("order", lambda w: w["word"])
    hashed = rare.select(idx, "block", "n", named.alias("named"), F.transform(named, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * SIGNS)).cast("int")).alias("places"))
    one_bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(w, F.lit(64)))
    within = lambda k: F.filter("places", lambda w: F.floor(w / 64) == k)
    bits = [F.aggregate(within(k), F.lit(0).cast("bigint"), lambda s, w: s.bitwiseOR(one_bit(w))).alias(f"bits{k}") for k in range(SIGNS)]
    first = hashed.select(idx, "block", "n", *bits, F.explode(_meeting(F.col("named"), F.col("n"), share)).alias("key"))
    first = first.select(idx, F.col("n").cast("int").alias("n"), *[f"bits{k}" for k in range(SIGNS)], F.xxhash64("block", "key").alias("key"))
    a, b = (first.select("key", *[F.col(c).alias(f"{p}_{c}") for c in first.columns if c != "key"]) for p in "lr")
    enough = lambda c: c * (1 + share) >= share * (F.col("l_n") + F.col("r_n")) - 1e-9
    lacks = lambda p, q: functools.reduce(Column.__add__, [F.bit_count(F.col(f"{p}_bits{k}").bitwiseAND(F.bitwise_not(f"{q}_bits{k}"))) for k in range(SIGNS)])
    may = (F.col(f"l_{idx}") < F.col(f"r_{idx}")) & enough(F.col("l_n") - lacks("l", "r")) & enough(F.col("r_n") - lacks("r", "l"))
    met = a.join(b, "key").where(may).select(f"l_{idx}", f"r_{idx}").distinct()
    side = lambda p: one.select(F.col(idx).alias(f"{p}_{idx}"), F.col("block").alias(f"{p}_block"), F.col("norm_title").alias(f"{p}_title"))
    both = met.join(side("l"), f"l_{idx}").join(side("r"), f"r_{idx}").where("l_block = r_block")
    return both.select(f"l_{idx}", f"r_{idx}", X.token_jaccard(F.col("l_title"), F.col("r_title")).alias("jaccard")).where(F.col("jaccard") >= share)


def _places(a: str) -> dict[str, int]:
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def _common(at: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence of the text with letters ``at`` and ``b``: no sequence of matching blocks is longer."""
    full = (1 << size) - 1
    free = full
    for c in b:
        hit = free & at.get(c, 0)
        free = (free + hit | free - hit) & full
    return size - free.bit_count()


class _Titles:
    """Titles as arrays: ``codes`` of their letters, a row for each place, padded by ``pad``, and how often each letter is in each title."""

    def __init__(self, texts: list[str], letters: np.ndarray):
        self.pad, self.sizes = len(letters), np.array([len(t) for t in texts])
        row = np.repeat(np.arange(len(texts)), self.sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        code = np.searchsorted(letters, _letters(texts))
        self.codes = np.full((self.sizes.max(), len(texts)), self.pad)
        self.codes[place, row] = code
        self.counts = np.bincount(row * self.pad + code, minlength=len(texts) * self.pad).reshape(len(texts), self.pad)

    def units(self, most: np.ndarray) -> np.ndarray:
        """A column for the first, second ... of each letter: a cell of the product of two such tables is the number of letters in common, whatever their order."""
        letter = np.repeat(np.arange(self.pad), most)
        nth = np.arange(len(letter)) - np.repeat(np.cumsum(most) - most, most)
        return (self.counts[:, letter] > nth).astype(np.float32)

    def masks(self, start: int) -> list[np.ndarray]:
        """Words of 64 places from ``start`` on: the places of each letter in each title."""
        out = []
        for first in range(start, len(self.codes), 64):
            word = np.zeros((self.codes.shape[1], self.pad + 1), dtype=np.uint64)
            for at, codes in enumerate(self.codes[first : first + 64]):
                word[np.arange(len(codes)), codes] |= np.uint64(1 << at)
            word[:, self.pad] = 0
            out.append(word.ravel())
        return out


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


def _reach(masks: list[np.ndarray], b: _Titles, i: np.ndarray, j: np.ndarray, need: np.ndarray, start: int) -> np.ndarray:
    """Places of those pairs (i, j) that have a common subsequence of ``need`` letters: ``_common`` of all pairs at once, letter by letter of ``b``.

    The first ``start`` letters are the same in all titles. A pair is dropped as soon as
    the letters that remain cannot make up what is missing.
    """
    left, row, ends = np.arange(len(i)), i * (b.pad + 1), b.sizes[j]
    free = [np.full(len(i), np.iinfo(np.uint64).max) for _ in masks]
    have = lambda: start + sum(64 - np.bitwise_count(f).astype(np.int64) for f in free)
    for at in range(start, ends.max(initial=0)):
        cell, carry = row + b.codes[at][j], None
        for k, places in enumerate(masks):
            hit = free[k] & places[cell]
            total = free[k] + hit
            over = total < hit
            if carry is not None:
                total += carry
                over |= carry & (total == 0)
            free[k] ^= hit
            free[k] |= total
            carry = over
        if at % 8 == 7:
            stay = have() + np.maximum(ends - at - 1, 0) >= need
            if np.count_nonzero(stay) < 0.9 * len(stay):
                left, row, j, ends, need, free = left[stay], row[stay], j[stay], ends[stay], need[stay], [f[stay] for f in free]
    return left[have() >= need]


def _near(ta: list[str], tb: list[str], same: bool) -> Iterator[tuple[int, int]]:
    """Places of the pairs of two lists (of one, if ``same``) whose longest common subsequence allows ``REVIEW_RATIO``."""
    total = np.arange(max(map(len, ta)) + max(map(len, tb)) + 1)
    least = np.ceil(REVIEW_RATIO * total / 2).astype(np.int64)
    share = lambda m: 2.0 * m / np.maximum(total, 1)
    least += (share(least) < REVIEW_RATIO).astype(np.int64) - (share(least - 1) >= REVIEW_RATIO)
    wa, wb = (np.array([k for k, t in enumerate(ts) if len(t) <= SHORT], dtype=np.int64) for ts in (ta, tb))
    if len(wa) and len(wb):
        sa, sb = [ta[k] for k in wa], [tb[k] for k in wb]
        letters = np.unique(_letters(sa + sb))
        a, b = _Titles(sa, letters), _Titles(sb, letters)
        most = np.minimum(a.counts.max(axis=0), b.counts.max(axis=0))
        ua, ub, start = a.units(most), b.units(most).T, len(os.path.commonprefix(sa + sb))
        masks = a.masks(start)
        for p in range(0, len(sa), TILE):
            q = p if same else 0
            need = least[a.sizes[p : p + TILE, None] + b.sizes[q:]]
            take = ua[p : p + TILE] @ ub[:, q:] >= need
            i, j = np.nonzero(np.triu(take, 1) if same else take)
            met = _reach(masks, b, p + i, q + j, need[i, j], start)
            yield from zip(wa[p + i[met]].tolist(), wb[q + j[met]].tolist())
    long = [{k for k, t in enumerate(ts) if len(t) > SHORT} for ts in (ta, tb)]
    for x, y in ((x, y) for x in range(len(ta)) for y in (range(len(tb)) if x in long[0] else long[1]) if x < y or not same):
        m = int(least[len(ta[x]) + len(tb[y])])
        if m <= min(len(ta[x]), len(tb[y])) and _common(_places(ta[x]), len(ta[x]), tb[y]) >= m:
            yield x, y


def _close(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of two parts of a block with ``REVIEW_RATIO`` or more, in both orders (the ratio is not symmetric).

    Bounds that no such pair fails come before the ratio itself: letters in common
    whatever their order, a product of two tables, then the longest common
    subsequence, for many pairs at once.
    """
    low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
    (ia, ta), (ib, tb) = ((d["id"].to_numpy(), d["norm_title"].tolist()) for d in (pdf[pdf["part"] == x] for x in (low, high)))
    rows = []
    for i, j in _near(ta, tb, low == high) if ta and tb else ():
        for x, y, s, t in ((ia[i], ib[j], ta[i], tb[j]), (ib[j], ia[i], tb[j], ta[i])):
            ratio = fuzzy_ratio(s, t)
            if ratio >= REVIEW_RATIO:
                rows.append((x, y, ratio))
    return pd.DataFrame(rows, columns=["l_id", "r_id", "ratio"])


def reviewed_titles(titles: DataFrame, idx: str = "occ_idx") -> DataFrame:
    """(l_norm_title, r_norm_title, ratio): distinct titles that may be up for review, in both orders, and every title with itself.

    A block is dealt into parts of about ``PART`` titles, and each two parts are one
    task's work, so a hot block is spread over the cluster. Pairs that meet on words come
    without a ratio, those with a ratio of ``REVIEW_RATIO`` among them a second time; see ``measured``.
    """
    one = titles.where(F.length("norm_title") >= 20).groupBy("norm_title").agg(F.min(idx).alias("id")).withColumn("block", block_key(F.col("norm_title")))
    parts = one.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.min("id").alias("group"))
    dealt = one.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("norm_title"), F.col("parts")).cast("int"))
    pieces = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("id", "norm_title", "group", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    close = spread(pieces, "group", "low", "high").groupBy("group", "low", "high").applyInPandas(lambda pdf: _close(pdf), "l_id long, r_id long, ratio double")
    same = one.select(F.col("id").alias("l_id"), F.col("id").alias("r_id"), F.lit(1.0).alias("ratio"))
    worded = _overlapping(_words(one), "id").select(F.explode(F.array(F.struct(F.col("l_id").alias("l_id"), F.col("r_id").alias("r_id")), F.struct(F.col("r_id").alias("l_id"), F.col("l_id").alias("r_id")))).alias("p")).select("p.*", F.lit(None).cast("double").alias("ratio"))
    name = lambda p: one.select(F.col("id").alias(f"{p}_id"), F.col("norm_title").alias(f"{p}_norm_title"))
    return close.unionByName(same).unionByName(worded).join(name("l"), "l_id").join(name("r"), "r_id").select("l_norm_title", "r_norm_title", "ratio")


def measured(pairs: DataFrame) -> DataFrame:
    """``pairs`` made of ``reviewed_titles`` once each, with both measures; ratios that are missing are only found for what is left by then."""
    asks = lambda p: F.when(F.col("ratio").isNull(), F.col(f"{p}_norm_title"))
    found = pairs.withColumn("worded", F.col("ratio").isNull()).withColumn("found", X.sequence_ratio(asks("l"), asks("r")))
    found = found.where(~F.col("worded") | (F.col("found") < REVIEW_RATIO)).withColumn("ratio", F.coalesce("ratio", "found")).drop("worded", "found")
    return found.withColumn("jaccard", X.token_jaccard(F.col("l_norm_title"), F.col("r_norm_title")))


def similar_pairs(titles: DataFrame, idx: str = "occ_idx", every: bool = False) -> DataFrame:
    """Pairs of titles of one block that may be one work, with both measures and a decision.

    ``titles`` has idx, norm_title, year, author1, doi: one row per cluster. Without
    ``every`` these are the pairs with ``REVIEW_JACCARD`` of common words, which holds
    every merge; with it also those that only the sequence ratio puts up for review.
    """
    side = lambda p: titles.select(*[F.col(c).alias(f"{p}{c}") for c in (idx, "norm_title", "year", "author1", "doi")])
    if every:
        pairs = reviewed_titles(titles, idx).join(side("l_"), "l_norm_title").join(side("r_"), "r_norm_title").where(F.col(f"l_{idx}") < F.col(f"r_{idx}"))
        pairs = measured(pairs)
    else:
        pairs = _overlapping(_words(titles), idx).join(side("l_"), f"l_{idx}").join(side("r_"), f"r_{idx}").withColumn("ratio", X.sequence_ratio("l_norm_title", "r_norm_title"))
    return pairs.withColumn("decision", decision())


def _merge_in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """The similar-title pass over one component, pair by pair as the clusters come; see ``similar_clusters``."""
    rows = pdf.sort_values("first").to_dict("records")
    root, members, top = list(range(len(rows))), {i: [i] for i in range(len(rows))}, {i: i for i in range(len(rows))}
    doi, since = {i: r["doi"] for i, r in enumerate(rows)}, [(-1, -1)] * len(rows)
    words = [set(r["norm_title"].split(" ")) for r in rows]
    ratios: dict[tuple[str, str], float] = {}
    out = []

    def close(i: int, until: tuple[int, int]) -> None:
        r = root[i]
        out.append((rows[i]["cluster"], rows[i]["first"], min(rows[m]["cluster"] for m in members[r]), rows[top[r]]["occ_idx"], doi[r], *since[i], *until, None, None))

    def merges(x: int, y: int) -> bool:
        a, b, (p, q) = rows[top[x]], rows[top[y]], (words[top[x]], words[top[y]])
        if doi[x] and doi[y] and doi[x] != doi[y] or a["year"] and b["year"] and abs(int(a["year"]) - int(b["year"])) > 1:
            return False
        match, missing = bool(a["author1"]) and a["author1"] == b["author1"], not a["author1"] or not b["author1"]
        jaccard = len(p & q) / len(p | q)
        if not (match or missing) or jaccard < SAME_AUTHOR[1]:
            return False
        pair = (a["norm_title"], b["norm_title"])
        if pair not in ratios:
            ratios[pair] = fuzzy_ratio(*pair)
        return match and ratios[pair] >= SAME_AUTHOR[0] or ratios[pair] >= NEAR_IDENTICAL[0] and jaccard >= NEAR_IDENTICAL[1]

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            x, y = root[i], root[j]
            if x == y or not merges(x, y):
                continue
            at = (rows[i]["first"], rows[j]["first"])
            for m in members[x] + members[y]:
                close(m, at)
                since[m] = at
            out.append((None, None, None, None, None, *at, *at, rows[members[x][0]]["first"], rows[members[y][0]]["first"]))
            best = max(top[x], top[y], key=lambda t: (rows[t]["p"], rows[t]["l"], -rows[t]["occ_idx"]))
            for m in members[y]:
                root[m] = x
            members[x], top[x], doi[x] = members[x] + members.pop(y), best, doi[x] or doi[y]
    for i in range(len(rows)):
        close(i, (NEVER, NEVER))
    return pd.DataFrame(out, columns=["cluster", "first", "joined", "top", "doi", "from_l", "from_r", "until_l", "until_r", "edge_l", "edge_r"]).astype({c: "Int64" for c in ("cluster", "first", "joined", "top", "edge_l", "edge_r")})


def similar_clusters(reps: DataFrame) -> DataFrame:
    """How the similar-title pass joins clusters: per cluster one row for each state it goes through.

    ``reps`` is what ``representatives`` gives (idx ``occ_idx``). The pass takes the
    pairs of a block in order; a merged cluster goes on under the better of the two
    representatives. What merges is always a pair of those, so only clusters linked
    by pairs that may merge depend on order; each such component is replayed. A state
    (``joined`` cluster, ``top`` record, ``doi``) holds for pairs of first records
    after ``from`` up to ``until``. Clusters that nothing can join give no row. Beside
    these stands one row, without a cluster, for every union: its first records ``edge_l`` and ``edge_r``.
    """
    titles = reps.where(F.length("norm_title") >= 20)
    one = titles.groupBy("norm_title").agg(F.min("occ_idx").alias("occ_idx"))
    name = lambda p: one.select(F.col("occ_idx").alias(f"{p}_occ_idx"), F.col("norm_title").alias(f"{p}_norm_title"))
    met = _overlapping(_words(one), "occ_idx", SAME_AUTHOR[1])
    alike = met.join(name("l"), "l_occ_idx").join(name("r"), "r_occ_idx").select("l_norm_title", "r_norm_title").unionByName(one.select(F.col("norm_title").alias("l_norm_title"), F.col("norm_title").alias("r_norm_title")))
    side = lambda p: titles.select(*[F.col(c).alias(f"{p}{c}") for c in ("cluster", "norm_title", "year", "author1", "doi")])
    author = (F.col("l_author1") == "") | (F.col("r_author1") == "") | (F.col("l_author1") == F.col("r_author1"))
    doi = (F.col("l_doi") == "") | (F.col("r_doi") == "") | (F.col("l_doi") == F.col("r_doi"))
    edges = alike.join(side("l_"), "l_norm_title").join(side("r_"), "r_norm_title").where((F.col("l_cluster") != F.col("r_cluster")) & author & doi & X.compatible_year(F.col("l_year"), F.col("r_year")))
    reach = smallest_members(edges.select(F.col("l_cluster").alias("a"), F.col("r_cluster").alias("b")))
    out = spread(titles.join(reach.withColumnRenamed("node", "cluster"), "cluster"), "component").groupBy("component").applyInPandas(lambda pdf: _merge_in_order(pdf), "cluster long, first long, joined long, top long, doi string, from_l long, from_r long, until_l long, until_r long, edge_l long, edge_r long")
    out._scratch = reach
    return out


def after_similar(clusters: DataFrame, states: DataFrame, idx: str = "occ_idx") -> DataFrame:
    """(idx, cluster, exact, third): clusters after the similar-title pass, beside those after the passes before."""
    last = states.where(F.col("until_l") == NEVER).select("cluster", "joined")
    return clusters.join(last, "cluster", "left").select(idx, F.coalesce("joined", "cluster").alias("cluster"), "exact", F.col("cluster").alias("third"))


def basis(edges: DataFrame, final: DataFrame, idx: str = "occ_idx") -> tuple[DataFrame, DataFrame]:
    """(idx, deduplication_basis) of every occurrence and (cluster, deduplication_basis) of every cluster: the reasons of its edges, or SINGLETON.

    ``edges`` is (a, b, reason) of all passes; an edge counts for both its ends.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias(idx), "reason").distinct()
    known = final.select(idx, "cluster").join(ends, idx, "left")
    said = F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set("reason")), " | "), F.lit("")), F.lit("SINGLETON")).alias("deduplication_basis")
    return known.groupBy(idx).agg(said), known.groupBy("cluster").agg(said)


def reviews(reps: DataFrame, states: DataFrame) -> DataFrame:
    """Every pair of clusters that the similar-title pass reviews, as the clusters stand when their turn comes.

    A pair whose clusters have merged with others by then may come up again, as in
    the sequential pass.
    """
    titles = reps.where(F.length("norm_title") >= 20)
    states = states.where("cluster is not null").drop("edge_l", "edge_r")
    alone = titles.join(states.select("cluster").distinct(), "cluster", "left_anti").select("cluster", "first", F.col("cluster").alias("joined"), F.col("occ_idx").alias("top"), "doi", *[F.lit(v).cast("long").alias(n) for n, v in (("from_l", -1), ("from_r", -1), ("until_l", NEVER), ("until_r", NEVER))])
    shown = alone.unionByName(states).join(titles.select(F.col("occ_idx").alias("top"), "norm_title", "year", "author1"), "top").withColumnRenamed("top", "occ_idx")
    side = lambda p: shown.select(*[F.col(c).alias(f"{p}{c}") for c in shown.columns])
    pairs = reviewed_titles(titles).join(side("l_"), "l_norm_title").join(side("r_"), "r_norm_title")
    now = F.struct("l_first", "r_first")
    holds = lambda p: (F.struct(f"{p}from_l", f"{p}from_r") < now) & (now <= F.struct(f"{p}until_l", f"{p}until_r"))
    due = pairs.where((F.col("l_first") < F.col("r_first")) & (F.col("l_joined") != F.col("r_joined")) & holds("l_") & holds("r_"))
    return measured(due).withColumn("decision", decision()).withColumn("rationale", rationale())


def decision() -> Column:
    """What becomes of a reviewed pair."""
    unlike = (F.col("l_doi") != "") & (F.col("r_doi") != "") & (F.col("l_doi") != F.col("r_doi"))
    match = (F.col("l_author1") != "") & (F.col("l_author1") == F.col("r_author1"))
    missing = (F.col("l_author1") == "") | (F.col("r_author1") == "")
    above = lambda t: (F.col("ratio") >= t[0]) & (F.col("jaccard") >= t[1])
    return F.when(unlike | ~X.compatible_year(F.col("l_year"), F.col("r_year")), "KEEP_SEPARATE").when((match & above(SAME_AUTHOR)) | ((match | missing) & above(NEAR_IDENTICAL)), "MERGE").otherwise("KEEP_SEPARATE")


def rationale() -> Column:
    """Why a reviewed pair is merged or kept apart."""
    unlike = (F.col("l_doi") != "") & (F.col("r_doi") != "") & (F.col("l_doi") != F.col("r_doi"))
    match = (F.col("l_author1") != "") & (F.col("l_author1") == F.col("r_author1"))
    # The words of the review.
    return (
        F.when(unlike, "conflicting non-empty DOIs")
        .when(~X.compatible_year(F.col("l_year"), F.col("r_year")), "publication years differ by more than one")
        .when(match & (F.col("ratio") >= SAME_AUTHOR[0]) & (F.col("jaccard") >= SAME_AUTHOR[1]), "very high title similarity and matching first author")
        .when(F.col("decision") == "MERGE", "near-identical titles with compatible author evidence")
        .otherwise("similar but below conservative fuzzy-merge threshold")
    )


def choose(field: str, idx: str = "occ_idx", longest: bool = False) -> Column:
    """Aggregate: the surviving value of a field, '' where no member has one."""
    order = F.struct(F.length(field), priority(F.col("system")), F.negative(idx)) if longest else F.struct(priority(F.col("system")), F.length(field), F.negative(idx))
    return F.coalesce(F.max_by(F.col(field), F.when(F.col(field) != "", order)), F.lit(""))


def strongest_status() -> Column:
    rank = F.coalesce(*[F.when(F.col("full_text_status") == s, i) for i, s in enumerate(STATUSES)])
    return F.coalesce(F.element_at(F.array(*map(F.lit, STATUSES)), F.min(rank) + 1), F.lit("NOT_IDENTIFIED"))


def packed(column: str) -> Column:
    """Aggregate: cleaned distinct values of a column, sorted; whole values, so one that holds several stays as it is."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(X.clean_space(F.col(column)), F.lit("")))), " | ")


def survivors(df: DataFrame, clusters: DataFrame, idx: str = "occ_idx") -> DataFrame:
    """One row per cluster: its surviving fields, places, systems, queries and number of occurrences; ``least`` is its first record."""
    fields = [choose(f, idx).alias(o) for f, o in (("title", "title"), ("authors", "authors"), ("year", "year"), ("publication_date", "publication_date"), ("source_title", "source_title_or_issuer"), ("document_type", "document_type"), ("url", "url"), ("language", "language")) if f in df.columns]
    sets = [packed(f).alias(o) for f, o in (("full_text_location", "full_text_locations"), ("system", "discovery_systems"), ("query_id", "query_ids"), ("family", "families"), ("source_record_id", "source_record_ids")) if f in df.columns]
    return df.join(clusters.select(idx, "cluster"), idx).groupBy("cluster").agg(
        *fields, F.coalesce(F.max(F.nullif("doi", F.lit(""))), F.lit("")).alias("doi"), choose("abstract_or_snippet", idx, longest=True).alias("abstract_or_snippet"),
        strongest_status().alias("full_text_status"), *sets, F.count("*").alias("occurrence_count"), F.min(idx).alias("least"),
        F.max(F.struct(priority(F.col("system")), F.length("title"), F.negative(idx), "norm_title", F.col("year").alias("best_year"), "canonical_url")).alias("best"),
    )


def with_corpus_ids(rows: DataFrame, clusters: DataFrame, idx: str = "occ_idx") -> DataFrame:
    """``rows`` of ``survivors`` with ``corpus_id``: of clusters with one key all but the first get a suffix from their members."""
    key = X.corpus_id(F.col("doi"), F.col("best.norm_title"), F.col("best.best_year"), F.col("best.canonical_url"))
    keyed = rows.withColumn("corpus_id", key)
    first = keyed.groupBy("corpus_id").agg(F.min("least").alias("owner"), F.count("*").alias("n")).where("n > 1")
    later = keyed.select("cluster", "corpus_id", "least").join(first, "corpus_id").where("least <> owner").select("cluster")
    listed = clusters.select(idx, "cluster").join(later, "cluster").groupBy("cluster").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(idx)), lambda i: i.cast("string")), ", "), F.lit("]")).alias("listed"))
    suffixed = keyed.join(listed, "cluster", "left")
    return suffixed.withColumn("corpus_id", F.concat("corpus_id", F.coalesce(F.concat(F.lit("-"), F.upper(F.substring(F.sha1("listed"), 1, 4))), F.lit("")))).drop("listed", "best")


def fuzzy_ratio(a: str, b: str) -> float:
    return X.matching_ratio(a, b)


class Resolution:
    """The four passes over finalised occurrences: what they join, refuse and review, each as a frame."""

    def __init__(self, rows: DataFrame, idx: str = "occ_idx"):
        scratch = Scratch(rows.sparkSession, "resolution")
        self.scratch, self.idx = scratch, idx
        self.rows = scratch.keep(rows)
        self.exact = scratch.keep(exact_clusters(self.rows, idx))
        self.unions = scratch.keep(url_unions(self.rows, self.exact, idx))
        joined = self.unions.where("what = 'join'").select("cluster", "joined")
        self.third = scratch.keep(self.exact.join(joined, "cluster", "left").select(idx, F.coalesce("joined", "cluster").alias("cluster"), F.col("cluster").alias("exact")))

    @functools.cached_property
    def reps(self) -> DataFrame:
        return self.scratch.keep(representatives(self.rows, self.third, self.idx))

    @functools.cached_property
    def states(self) -> DataFrame:
        return self.scratch.keep(similar_clusters(self.reps))

    @functools.cached_property
    def final(self) -> DataFrame:
        return self.scratch.keep(after_similar(self.third, self.states, self.idx))

    def edges(self) -> DataFrame:
        """(a, b, reason) of every union."""
        by_url = self.unions.where("what = 'edge'").select("a", "b", F.lit("CANONICAL_URL").alias("reason"))
        by_title = self.states.where("edge_l is not null").select(F.col("edge_l").alias("a"), F.col("edge_r").alias("b"), F.lit("FUZZY_TITLE_AUTHOR").alias("reason"))
        return exact_edges(self.rows, self.idx).unionByName(by_url).unionByName(by_title)

    def conflicts(self) -> DataFrame:
        """Every refusal: match_key, reason, DOIs and titles of both sides; distinct."""
        return title_conflicts(self.rows, self.idx).unionByName(url_conflicts(self.rows, self.exact, self.unions, self.idx))

    def reviews(self) -> DataFrame:
        return reviews(self.reps, self.states)

    def corpus(self) -> DataFrame:
        """One row per cluster with id, survivors and basis, and ``least`` for the order of output."""
        _, by_cluster = basis(self.edges(), self.final, self.idx)
        return self._own(with_corpus_ids(survivors(self.rows, self.final, self.idx), self.final, self.idx).join(by_cluster, "cluster"))

    def provenance(self) -> DataFrame:
        """One row per occurrence: its cluster's corpus_id, where it comes from, and its own basis."""
        by_row, _ = basis(self.edges(), self.final, self.idx)
        ids = with_corpus_ids(survivors(self.rows, self.final, self.idx), self.final, self.idx).select("cluster", "corpus_id", "least")
        return self._own(self.rows.join(self.final.select(self.idx, "cluster"), self.idx).join(ids, "cluster").join(by_row, self.idx))

    def _own(self, df: DataFrame) -> DataFrame:
        df._resolution = self
        return df
