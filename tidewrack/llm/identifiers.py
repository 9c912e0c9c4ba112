"""Identifier and title keys as Column expressions, for linking however they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions import unicode as U

# Query parameters that only track the visit.
TRACKING = r"utm_[a-z_]+|gclid|fbclid|msclkid|dclid|yclid|mc_cid|mc_eid|ref|source|igshid|_ga"
# Page paths that show a portal, not a work.
PORTAL = r"(?:|/index\.\w+|/default\.\w+|/home|/search|/login|/signin|/sign-in|/browse|/about|/contact|/help|/results|/register|/catalog|/catalogue|/portal|/main)"
# Titles that name no work.
NO_WORK = (
    "abstract", "abstracts", "annual report", "announcement", "appendix", "author index", "back matter", "bibliography",
    "biographical note", "book review", "book reviews", "call for papers", "comment", "comments", "conference abstracts",
    "contents", "correction", "corrigendum", "cover", "data", "data set", "dataset", "discussion", "editorial",
    "editorial board", "environmental impact statement", "environmental statement", "errata", "erratum", "figures",
    "final report", "foreword", "front matter", "in memoriam", "index", "introduction", "issue information",
    "letter to the editor", "masthead", "n a", "na", "news", "no title", "none", "not available", "notes", "null",
    "obituary", "poster abstracts", "preface", "proceedings", "program", "programme", "progress report", "publisher s note",
    "references", "reply", "report", "response", "retraction", "review", "reviews", "short communication", "subject index",
    "summary", "supplement", "supplementary data", "supplementary information", "supplementary material",
    "supplementary materials", "supporting information", "table of contents", "technical report", "thesis", "title",
    "title page", "unknown", "untitled", "untitled document", "volume information",
)


def unquoted(x: Column) -> Column:
    """Percent escapes decoded (a plus stays a plus); text that is no valid escape stays."""
    return U.let(x, lambda x: F.when(x.contains("%"), F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)).otherwise(x))


def doi_text(x: Column) -> Column:
    """Whatever has the form of a DOI in ``x``, lower-cased and free of prefixes and closing marks; null where there is none."""
    plain = F.lower(U.beyond_ascii(unquoted(x), lambda v: U.compatibility(U.visible(v))))
    found = F.regexp_extract(plain, r"10\.\d{4,9}/[^\s\"<>]+", 0)
    found = F.regexp_replace(found, r"[.,;:\]}'\"]+$", "")
    found = U.let(found, lambda d: F.when(d.rlike(r"^[^(]*\)+$"), F.regexp_replace(d, r"\)+$", "")).otherwise(d))
    return U.let(found, lambda d: F.when(d.rlike("^[^/]+/."), d))


def doi_key(x: Column) -> Column:
    """The DOI in ``x`` as it links records; null where there is none.

    Stand-ins link nothing: a suffix of zeros only, or a word for unknown.
    """
    real = lambda d: ~d.rlike(r"^(?:10\.0+/.*|[^/]+/(?:0+|x+|-+|n/?a|none|null|unknown|pending|missing|tba|tbd|not[ _-]?(?:assigned|available|known)|undefined|test|example))$")
    return U.let(doi_text(x), lambda d: F.when(real(d), d))


def url_doi_key(x: Column) -> Column:
    """The DOI of a resolver address; null for other addresses."""
    return F.when(x.rlike(r"(?i)^\s*(?:https?://)?(?:www\.)?(?:dx\.)?doi\.\w+/"), doi_key(x))


def page_key(x: Column) -> Column:
    """A page address without what does not change the page; null for none, portals and resolvers."""
    bare = F.regexp_replace(U.beyond_ascii(F.trim(x), U.visible), r"#.*$|(?i)^(?:https?:)?//|^\s+", "")
    parts = lambda b: F.struct(
        F.regexp_replace(F.lower(F.regexp_extract(b, r"^([^/?\s]+)", 1)), r"^www\d?\.|:(?:80|443)$|\.(?=:|$)", "").alias("host"),
        F.regexp_replace(F.regexp_replace(F.regexp_extract(b, r"^[^/?\s]+(/[^?]*)", 1), "/{2,}", "/"), "/+$", "").alias("path"),
        F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(b, r"^[^?]*\?(.*)$", 1), "[&;]"), lambda q: (q != "") & ~q.rlike(rf"(?i)^(?:{TRACKING})(?:=|$)"))), "&").alias("query"),
    )
    portal = lambda p: (p.query == "") & F.lower(p.path).rlike(rf"^{PORTAL}$")
    real = lambda p: p.host.rlike(r"^[^\s.]+(?:\.[^\s.]+)+$") & ~portal(p) & ~p.host.rlike(r"^(?:dx\.)?doi\.\w+$")
    whole = lambda p: F.concat(p.host, unquoted(p.path), F.when(p.query == "", "").otherwise(F.concat(F.lit("?"), p.query)))
    return U.let(bare, lambda b: U.let(parts(b), lambda p: F.when(real(p), whole(p))))


def title_key(x: Column) -> Column:
    """A title as compared: any look-alikes, case, accents, marks, tags and leading article alike.

    Null where there is no title or one that names no work.
    """

    def unmarked(v: Column) -> Column:
        v = U.let(v, lambda t: F.when(t.contains("<"), F.regexp_replace(t, r"(?i)</?[a-z][a-z0-9]{0,9}/?>", "")).otherwise(t))
        ands = lambda t: F.replace(F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("＆"), F.lit("&")), "(?i)&amp;", "&"), r"(?i)&(?:nbsp|thinsp|ensp|emsp|quot|apos|lt|gt|ndash|mdash|rsquo|lsquo|ldquo|rdquo|#\d+);", " "), F.lit("&"), F.lit(" and "))
        return U.let(v, lambda t: F.when(t.contains("&") | t.contains("＆"), ands(t)).otherwise(t))

    plain = F.lower(U.beyond_ascii(unmarked(x), lambda v: U.without_accents(U.folded_lookalikes(U.compatibility(U.visible(v))))))
    words = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    words = F.regexp_replace(words, r"^(?:the|an|a) (?=.)", "")
    return U.let(words, lambda w: F.when((w != "") & ~w.isin(*NO_WORK), w))
