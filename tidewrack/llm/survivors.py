"""Best representative of each duplicate group: Bayesian fusion with copy detection.

Every member of a group claims a value for each field. A value is real, or false:
a stand-in or page furniture. No list says which; false values betray themselves
by being shared. A real text or identifier belongs to one work, so it stands in
one group or, where links failed, in a few; a false one stands beside many
unrelated works. The *spread* of a value is the number of works it was seen with,
each told by what else its group claims: groups that claim the same two values
copy one another and are one witness. A group whose claimants depend on those of
another one is discounted by the probability that they copied.

Real and false values have their own geometric distribution of spreads, fitted by
expectation-maximisation over all values of a field, so nothing hangs on the size
of the input. The log-odds of a value in a group are the votes of its sources,
each weighing the logit of its accuracy and discounted by what it may have copied
from more accurate ones, plus what its spread says. From the posteriors come the
accuracies of the sources, from the false values that two sources share in one
group their dependence, and all is done again, for a fixed number of rounds.

What is real by its posterior may survive. Among several real values decides the
posterior (``prior="votes"``) or, with ``prior="order"``, a stated order (the
longest text, the strongest status, the more trusted system, the later date).

Scale: claims are reduced to 64-bit value ids before the first shuffle and merged
map-side per group, field and value; of the values only those seen with several
works are joined back. Tables of sources (checked to be few) and histograms of
bounded size come to the driver. No group is ever gathered into one task.
At n values of a field two ids collide with a chance of about n*n/2**65; such a
pair would count as one value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewrack.functions import unicode as U
from tidewrack.llm import identifiers as I
from tidewrack.operators.resolution import PRIORITY, STATUSES
from tidewrack.session import Scratch

#: More sources than this are no sources but values; the tables about them come to the driver.
MAX_SOURCES = 64
#: Chance that a source copies at all, share of its values then copied, and false values a field can take.
COPY_PRIOR, COPY_SHARE, FALSE_VALUES = 0.1, 0.8, 20.0
START_ACCURACY, ROUNDS = 0.8, 2
#: What a spread model starts from: chance of another work beside a real and a false value, share of real values.
START_REAL, START_FALSE, START_SHARE = 0.01, 0.9, 0.9


@dataclass(frozen=True)
class Field:
    """A field to fuse: its column (null: no value), the form in which values are told apart, and their rank.

    Values of a ``closed`` vocabulary are shared by nature, so spread says nothing of them.
    """

    name: str
    value: Column
    form: Callable[[Column], Column]
    rank: Callable[[Column], Column]
    closed: bool = False


def _label(x: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(U.beyond_ascii(x, lambda v: U.squeeze(U.lookalikes(U.compatibility(U.visible(v))))), r"[\s_-]+", " ")))


def source_label(x: Column) -> Column:
    """A system's name however it is written."""
    return F.coalesce(F.nullif(_label(x), F.lit("")), F.lit("?"))


def text_form(text: Column) -> Column:
    """A text without case, doubled blanks and outer marks, its host names masked: what one page says on every site."""
    masked = lambda v: F.when(v.rlike(r"\.\p{L}{2}"), F.regexp_replace(v, r"[\p{L}\p{N}-]+(?:\.[\p{L}-]{2,})+", "@")).otherwise(v)
    return F.trim(F.regexp_replace(U.let(F.lower(text), masked), r"\s{2,}", " "), F.lit(" .,:;!?[](){}\"'\u2026\n\t"))


def record_fields() -> list[Field]:
    """doi, abstract_or_snippet and full_text_status of the records."""
    text = F.col("abstract_or_snippet")
    status = F.nullif(F.regexp_replace(_label(F.col("full_text_status")), " ", "_"), F.lit(""))
    ladder = lambda v: F.coalesce(*[F.when(v == s, len(STATUSES) - i) for i, s in enumerate(STATUSES)], F.lit(0))
    return [
        Field("doi", I.doi_text(F.col("doi")), lambda v: v, lambda v: F.lit(0)),
        Field("abstract_or_snippet", F.when(text.rlike(r"[\p{L}\p{N}]"), text), text_form, F.length),
        Field("full_text_status", status, lambda v: v, ladder, closed=True),
    ]


def claims(records: DataFrame, groups: DataFrame, fields: list[Field]) -> DataFrame:
    """One row per claimed value: group, field, source, value id, and its place in the stated order."""
    priority = lambda c: F.coalesce(*[F.when(c == s.upper(), p) for s, p in PRIORITY.items()], F.lit(0))
    source = U.let(source_label(F.col("system")), lambda c: F.struct(c.alias("source"), priority(c).alias("priority")))
    date = F.coalesce(F.unix_date(F.try_to_date(F.trim("retrieved_date"), "yyyy-MM-dd")), F.lit(-1_000_000))
    one = lambda i, f: U.let(f.value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(i).alias("field"), F.xxhash64(f.form(v)).alias("value_id"), (-f.rank(v)).alias("rank"))))
    slim = records.select("occurrence_id", source.alias("s"), date.alias("date"), F.array_compact(F.array(*[one(i, f) for i, f in enumerate(fields)])).alias("values"))
    return (
        slim.where(F.size("values") > 0)
        .join(groups, "occurrence_id")
        .select("group_id", "s.source", F.explode("values").alias("v"), (-F.col("s.priority")).alias("p"), (-F.col("date")).alias("d"), "occurrence_id")
        .select("group_id", "v.field", "source", "v.value_id", F.struct(F.col("v.rank").alias("rank"), "p", "d", "occurrence_id").alias("place"))
    )


def _sources(objects: DataFrame) -> list[str]:
    names = [r[0] for r in objects.select(F.explode("sources")).distinct().limit(MAX_SOURCES + 1).collect()]
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return sorted(names)


def _pairs(sources: Column) -> Column:
    pairs = F.flatten(F.transform(sources, lambda a: F.transform(F.filter(sources, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.explode(pairs).alias("pair")


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def dependence(objects: DataFrame, judged: DataFrame, accuracy: dict[str, float]) -> dict[str, float]:
    """Probability that two sources depend on each other, keyed ``a|b`` with a < b.

    ``objects`` is (group_id, field, sources) of everything asked, ``judged``
    (sources, real) of every value. Sharing a false value is what copies give away.
    """
    together = judged.select("real", _pairs(F.col("sources"))).groupBy("pair").agg(F.count_if(~F.col("real")).alias("kf"), F.count_if("real").alias("kt"))
    met = objects.select(_pairs(F.col("sources"))).groupBy("pair").agg(F.count("*").alias("n"))
    found = {}
    for r in met.join(together, "pair", "left").na.fill(0).collect():  # at most MAX_SOURCES squared
        a, b = accuracy[r.pair.a], accuracy[r.pair.b]
        kd = max(0, r.n - r.kt - r.kf)
        same_true, same_false = a * b, (1 - a) * (1 - b) / FALSE_VALUES
        copied = max(a, b)
        odds = math.log(COPY_PRIOR / (1 - COPY_PRIOR))
        for k, alone, by_copy in ((r.kt, same_true, copied), (r.kf, same_false, 1 - copied)):
            odds += k * math.log((by_copy * COPY_SHARE + alone * (1 - COPY_SHARE)) / alone)
        odds += kd * math.log(1 - COPY_SHARE)
        found[f"{r.pair.a}|{r.pair.b}"] = 1 / (1 + math.exp(-max(-500, min(500, odds))))
    return found


def _alone(depends: dict[str, float], earlier: Column) -> Callable[[Column], Column]:
    """The share of a source's word that is its own beside the ``earlier`` sources."""
    if not depends:
        return lambda s: F.lit(1.0)
    known = _map(depends)
    between = lambda a, b: F.coalesce(known[F.concat_ws("|", F.least(a, b), F.greatest(a, b))], F.lit(0.0))
    return lambda s: F.aggregate(earlier, F.lit(1.0), lambda t, o: t * (1 - COPY_SHARE * between(s, o)))


def _votes(accuracy: dict[str, float], depends: dict[str, float], false_values: float) -> Column:
    """Log votes of a value's sources, the more accurate first, later ones discounted by what they may have copied."""
    rank = {s: i for i, s in enumerate(sorted(accuracy, key=lambda s: (-accuracy[s], s)))}
    weight, place = _map({s: math.log(false_values * a / (1 - a)) for s, a in accuracy.items()}), _map(rank)
    own = lambda s: _alone(depends, F.filter("sources", lambda o: place[o] < place[s]))(s)
    return F.aggregate("sources", F.lit(0.0), lambda t, s: t + weight[s] * own(s))


def _spread(depends: dict[str, float]) -> Column:
    """Works a value was seen with: of every source the first one discounted by what it may have copied from those before."""
    own = lambda w: _alone(depends, F.transform(F.filter("works", lambda o: o.source < w.source), lambda o: o.source))(w.source)
    return F.aggregate("works", F.lit(0.0), lambda t, w: t + (w.n - 1) + own(w))


def fit_spread(shared: Iterable[tuple[float, int]], alone: int) -> tuple[float, float]:
    """Chances of another work beside a real and beside a false value, from a histogram of spreads.

    ``shared`` has (works beyond the first, values), ``alone`` is the number of values
    seen with one work. Two geometric distributions, by expectation-maximisation from
    fixed starts, with a few pseudo-values so that small inputs have a result.
    """
    bins = [(0.0, alone), *shared]
    real, false, share = START_REAL, START_FALSE, START_SHARE
    for _ in range(100):
        n = k = m = j = 0.0
        for extra, count in bins:
            odds = math.log(share / (1 - share) * (1 - real) / (1 - false)) + extra * math.log(real / false)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            n, k = n + p * count, k + p * count * extra
            m, j = m + (1 - p) * count, j + (1 - p) * count * extra
        real = min(0.3, (k + 10 * START_REAL) / (k + n + 10))
        false = max(0.5, min(0.9999, (j + 10 * START_FALSE) / (j + m + 10)))
        share = min(0.9999, max(0.0001, (n + 10 * START_SHARE) / (n + m + 10)))
    return real, false


def fuse(claimed: DataFrame, prior: str = "order", rounds: int = ROUNDS, closed: tuple[int, ...] = (), copies: bool = True) -> DataFrame:
    """(group_id, field, value_id, occurrence_id, posterior): the surviving value of every group and field.

    ``occurrence_id`` is the claim of that value that comes first in the stated order.
    ``prior`` is ``order`` (the stated order decides between real values) or ``votes``
    (the posterior does). Groups in which a field has only false values give no row.
    Null or unknown sources count as one source named ``?``. ``closed`` are fields of
    a fixed vocabulary; without ``copies`` no vote is discounted.
    """
    scratch = Scratch(claimed.sparkSession, "fusion")
    votes = scratch.keep(claimed.groupBy("group_id", "field", "value_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min("place").alias("place")))
    # Of every group and field: who claims anything, and two values that tell the work by what stands beside a value.
    objects = scratch.keep(votes.groupBy("group_id", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"), F.min("value_id").alias("low"), F.max("value_id").alias("high")))
    names = _sources(objects)
    if not names:
        return votes.select("group_id", "field", "value_id", F.col("place.occurrence_id").alias("occurrence_id"), F.lit(0.0).alias("posterior"))
    open_ = ~F.col("field").isin(*closed) if closed else F.lit(True)
    beside = votes.where(open_).select("group_id", "field", "value_id", F.col("sources")[0].alias("source")).join(objects.select("group_id", "field", "low", "high"), ["group_id", "field"])
    work = F.when(F.col("value_id") != F.col("low"), F.col("low")).otherwise(F.col("high"))
    works = beside.groupBy("field", "value_id", work.alias("work")).agg(F.min("source").alias("source")).groupBy("field", "value_id", "source").agg(F.count("*").alias("n"))
    values = works.groupBy("field", "value_id").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("works"))
    counted, fields = Observation(), [r.field for r in objects.select("field").distinct().collect() if r.field not in closed]  # one row a field
    several = (F.size("works") > 1) | (F.col("works")[0]["n"] > 1)
    if fields:
        values = values.observe(counted, *[F.count_if((F.col("field") == f) & ~several).alias(f"f{f}") for f in fields])
    shared = scratch.keep(values.where(several))
    alone = counted.get if fields else {}

    accuracy, depends = dict.fromkeys(names, START_ACCURACY), {}
    judged, says = votes, F.lit(0.0)
    for k in range(max(1, rounds)):
        spread = shared.withColumn("spread", _spread(depends))
        size = F.when(F.col("spread") < 8, F.round(F.col("spread") * 20)).otherwise(160 + F.floor(F.log2("spread") * 4)).cast("int")
        histogram = spread.groupBy("field", size.alias("size")).agg(F.count("*").alias("values"), F.avg("spread").alias("spread")).collect()  # some 400 bins a field at most
        models = {f: fit_spread([(r.spread - 1, r["values"]) for r in histogram if r.field == f], alone[f"f{f}"] or 0) for f in fields}
        per_field = lambda get: F.coalesce(*[F.when(F.col("field") == f, get(*m)) for f, m in models.items()], F.lit(0.0))
        says = per_field(lambda real, false: math.log((1 - real) / (1 - false))) + F.coalesce(F.col("spread") - 1, F.lit(0.0)) * per_field(lambda real, false: math.log(real / false))
        says = F.when(open_, says).otherwise(0.0)
        judged = votes.join(spread.select("field", "value_id", "spread"), ["field", "value_id"], "left")
        if k + 1 < rounds:
            odds = _votes(accuracy, depends, 1.0) + says
            real = judged.where(open_).select("sources", (1 / (1 + F.exp(-F.greatest(F.lit(-300.0), F.least(F.lit(300.0), odds))))).alias("p"))
            means = real.select(F.explode("sources").alias("source"), "p").groupBy("source").agg(F.avg("p").alias("a")).collect()  # at most MAX_SOURCES
            accuracy = accuracy | {r.source: min(0.99, max(0.05, r.a)) for r in means}
            if copies:
                depends = dependence(objects, real.select("sources", (F.col("p") > 0.5).alias("real")), accuracy)
    real = judged.withColumn("real", _votes(accuracy, depends, 1.0) + says).where((F.col("real") > 0) | ~open_)
    scored = real.withColumn("odds", F.exp(F.greatest(F.lit(-300.0), F.least(F.lit(300.0), _votes(accuracy, depends, FALSE_VALUES) + says))))
    key = F.struct("place", "value_id", "odds") if prior == "order" else F.struct((-F.col("odds")).alias("least"), "place", "value_id", "odds")
    best = scored.groupBy("group_id", "field").agg(F.min(key).alias("best"), F.sum("odds").alias("total"))
    out = best.select("group_id", "field", F.col("best.value_id").alias("value_id"), F.col("best.place.occurrence_id").alias("occurrence_id"), (F.col("best.odds") / (F.col("total") + 1)).alias("posterior"))
    out._scratch = scratch
    return out


def survivors(records: DataFrame, groups: DataFrame, prior: str = "order", copies: bool = True) -> DataFrame:
    """(group_id, field_name, occurrence_id, posterior): whose value survives, per group and field.

    ``groups`` is (occurrence_id, group_id). Null, empty and blank values claim
    nothing; repeated rows change nothing; records in no group are left out.
    """
    fields = record_fields()
    name = F.element_at(F.array(*[F.lit(f.name) for f in fields]), F.col("field") + 1)
    fused = fuse(claims(records, groups, fields), prior, closed=tuple(i for i, f in enumerate(fields) if f.closed), copies=copies)
    out = fused.select("group_id", name.alias("field_name"), "occurrence_id", "posterior")
    out._scratch = fused
    return out
