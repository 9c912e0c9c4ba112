"""Consolidating pairwise matches into groups, by deterministic Boruvka hooking.

Every component selects its smallest outgoing edge, the trees so made collapse
by pointer doubling, edges are relabelled with the roots and deduplicated, until
no edge is left. Edges are ordered by (smaller end, larger end), so the smallest
edge of a component leads to its smallest neighbour, and only the two components
of a mutually chosen edge can point at each other; the smaller one is the root.

Each round is a few equi-joins and pre-aggregated minima over plain longs. What
a round starts from is a written table in the shared folder, so lineage stays
short and a lost executor costs only the tasks it ran. Nothing but row counts
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import unicode as U
from tidewrack.llm import identifiers as I
from tidewrack.session import Scratch


def _doubled(parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved"))


def _collapse(scratch: Scratch, chosen: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent) whose only cycles are pairs."""
    up = chosen.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    paired = (F.col("grand") == F.col("node")) & (F.col("node") < F.col("parent"))
    kept = scratch.keep(chosen.join(up, "parent", "left").select("node", F.when(paired, F.col("node")).otherwise(F.col("parent")).alias("parent")))
    while True:
        twice = _doubled(_doubled(kept).drop("moved"))
        doubled = scratch.keep(twice, F.count_if("moved").alias("moved"))
        scratch.drop(kept)
        kept = doubled.select("node", "parent")
        kept._tidewrack_path = doubled._tidewrack_path
        if not doubled.measured["moved"]:
            roots = kept.select("node", F.col("parent").alias("root"))
            roots._tidewrack_path = kept._tidewrack_path
            return roots


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges``: the component under one representative.

    ``edges`` has two columns of one orderable type. Self loops and nulls are
    dropped, repeated and reversed edges count once. No edges give no rows. The
    root is the same on every run, but not always the component's smallest node.
    """
    scratch = Scratch(edges.sparkSession, "components")
    lo, hi = F.least(a, b), F.greatest(a, b)
    now = scratch.keep(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo.alias("a"), hi.alias("b")).distinct())
    labels: DataFrame | None = None
    while now.measured["rows"]:
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
        roots = _collapse(scratch, both.groupBy(F.col("e.node").alias("node")).agg(F.min("e.other").alias("parent")))
        left = now.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        following = scratch.keep(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        scratch.drop(now)
        now = following
        if labels is None:
            labels = roots
        else:
            joined = labels.withColumnRenamed("root", "old").join(roots.select(F.col("node").alias("old"), F.col("root")), "old", "left")
            lifted = scratch.keep(joined.select("node", F.coalesce("root", "old").alias("root")))
            scratch.drop(labels)
            scratch.drop(roots)
            labels = lifted
    if labels is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels._scratch = scratch
    return labels


def record_keys(records: DataFrame) -> DataFrame:
    """(occurrence_id, keys): 64-bit hashes of what a record can be linked by.

    Keys are the DOI (of the field and of a resolver address), the page address and
    the title, each however written; stand-ins, portal pages and titles that name
    no work give none. At n distinct keys two of them collide with a chance of
    about n*n/2**65.
    """
    tagged = lambda tag, key: U.let(key, lambda k: F.when(k.isNotNull(), F.xxhash64(F.lit(tag), k)))
    doi, url = F.col("doi"), F.col("url")
    keys = F.array_compact(F.array(tagged("t", I.title_key(F.col("title"))), tagged("d", I.doi_key(doi)), tagged("d", I.url_doi_key(url)), tagged("u", I.page_key(url))))
    return records.select("occurrence_id", F.array_distinct(keys).alias("keys"))


def link_groups(keyed: DataFrame) -> DataFrame:
    """(occurrence_id, group_id) of every record in a group of two or more.

    ``keyed`` has occurrence_id and keys (array of longs). The graph is one of
    keys: a record with several keys is an edge from its first to each other one,
    so a key shared by a third of all records is still one node, and records that
    repeat an edge are merged before they are shuffled. Records without any key,
    and null ids, are in no group; a repeated occurrence_id counts once.
    """
    scratch = Scratch(keyed.sparkSession, "groups")
    kept = scratch.keep(keyed.where("occurrence_id is not null and size(keys) > 0").select("occurrence_id", "keys"))
    edges = kept.where("size(keys) > 1").select(F.col("keys")[0].alias("a"), F.explode(F.slice("keys", 2, F.size("keys") - 1)).alias("b"))
    labels = components(edges)
    # Of every first key: its smallest record and whether there is a second one, merged before the shuffle.
    first = kept.select(F.col("keys")[0].alias("node"), "occurrence_id")
    size = [F.min("occurrence_id").alias("least"), F.max("occurrence_id").alias("most")]
    by_key = first.groupBy("node").agg(*size)
    rooted = by_key.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "most")
    rooted = scratch.keep(rooted)
    groups = rooted.groupBy("root").agg(F.min("least").alias("group_id"), F.max("most").alias("most")).where("group_id <> most").select("root", "group_id")
    of_key = rooted.select("node", "root").join(groups, "root").select("node", "group_id")
    found = first.join(of_key, "node").select("occurrence_id", "group_id").distinct()
    found._scratch = (scratch, labels)
    return found
