"""Chains and fallbacks: aliases, decompositions, labels, and usage rolled up along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import durable


def _followed(edges: DataFrame) -> tuple[DataFrame, bool]:
    """(node, at, steps, open) of every source of edges (src, dst), one for each source; and whether any is open.

    Each round joins the jumps with themselves, which doubles their reach, so a chain of n edges takes log2(n) rounds and
    no row ever holds a path. What is still open when jumps reach further than there are edges leads into a ring.
    """
    jumps = durable(edges.select(F.col("src").alias("node"), F.col("dst").alias("at"), F.lit(1).cast("long").alias("steps")), "jumps")
    for _ in range(jumps.count().bit_length() + 1):
        ahead = jumps.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("steps").alias("more"))
        longer = F.col("steps") + F.coalesce("more", F.lit(0))
        jumps = jumps.join(ahead, "at", "left").select("node", F.coalesce("far", "at").alias("at"), longer.alias("steps"), F.col("far").isNotNull().alias("open"))
        jumps = durable(jumps, "jumps")
        if jumps.where("open").isEmpty():
            return jumps, False
    return (jumps, True) if "open" in jumps.columns else (jumps.withColumn("open", F.lit(False)), False)


def _into_rings(jumps: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, at, steps) of the open nodes: each stops at the last node before its chain meets itself."""
    ring = durable(jumps.where("open").select(F.col("at").alias("node")).distinct(), "ring")
    own = edges.join(ring, edges["src"] == ring["node"], "left_semi")
    # the smallest node that a jump passes names the ring, once jumps are as long as it
    low = durable(own.select(F.col("src").alias("node"), F.col("dst").alias("at"), F.least("src", "dst").alias("low")), "rings")
    for _ in range(low.count().bit_length()):
        ahead = low.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("low").alias("far_low"))
        low = durable(low.join(ahead, "at").select("node", F.col("far").alias("at"), F.least("low", "far_low").alias("low")), "rings")
    sizes = low.groupBy("low").agg(F.count("*").alias("size"))
    stops = low.join(sizes, "low").select("node", (F.col("size") - 1).alias("round"))
    stops = stops.join(own.select(F.col("dst").alias("node"), F.col("src").alias("stop")), "node")
    tails = edges.join(ring, edges["src"] == ring["node"], "left_anti").join(jumps.where("open").select(F.col("node").alias("src")), "src", "left_semi")
    entries = _followed(tails)[0].select("node", F.col("at").alias("entry"), "steps")
    entries = entries.unionByName(ring.select("node", F.col("node").alias("entry"), F.lit(0).cast("long").alias("steps")))
    return entries.join(stops.withColumnRenamed("node", "entry"), "entry").select("node", F.col("stop").alias("at"), (F.col("steps") + F.col("round")).alias("steps"))


def chain_ends(start: DataFrame, edges: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """node, chain_end, steps, resolved: where each node of `start` (node) comes to by edges (src, dst).

    A chain goes on while it has an edge and has not come to a live node; without `live` it goes to its last node. A
    chain that meets itself stops before it does, and is not resolved. Chains may have any length; of several edges of a
    node the one to the smallest node counts.
    """
    alive = edges.select(F.col("src").alias("node")).limit(0) if live is None else live.select("node").distinct()
    once = edges.where("src is not null and dst is not null").groupBy("src").agg(F.min("dst").alias("dst"))
    # no step leaves a live node
    usable = durable(once.join(alive, once["src"] == alive["node"], "left_anti"), "usable")
    jumps, rings = _followed(usable)
    ends = jumps.where("not open").select("node", "at", "steps", F.lit(False).alias("ring"))
    if rings:
        ends = ends.unionByName(_into_rings(jumps, usable).withColumn("ring", F.lit(True)))
    out = start.select("node").distinct().join(ends, "node", "left")
    out = out.select("node", F.coalesce("at", "node").alias("chain_end"), F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("ring", F.lit(False)).alias("ring"))
    if live is None:
        return out.select("node", "chain_end", "steps", (~F.col("ring")).alias("resolved"))
    named = alive.select(F.col("node").alias("chain_end"), F.lit(True).alias("named"))
    return out.join(named, "chain_end", "left").select("node", "chain_end", "steps", F.coalesce("named", F.lit(False)).alias("resolved"))


def former_names(ends: DataFrame) -> DataFrame:
    """chain_end and the sorted nodes that lead to it: the inverse of resolution."""
    return ends.where("resolved and node <> chain_end").groupBy("chain_end").agg(F.array_sort(F.collect_list("node")).alias("former"))


def successor(replaced_by: Column) -> Column:
    """The first of a list between pipes."""
    return F.split(replaced_by, r"\|")[0]


def resolve_labels(labels: DataFrame, live: DataFrame, ends: DataFrame, delegated: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """label, target, how: the first of four ways that answers.

    A live label (live: label, target); the end of its decomposition chain (ends: node, chain_end); a delegation of the
    label itself (delegated: label, target); the crosswalk entry of the chain's end (crosswalk: label, target).
    """
    named = lambda df, key, value: df.select(F.col(key).alias("_k"), F.col("target").alias(value)).dropDuplicates(["_k"])
    out = labels.join(named(live, "label", "_live"), labels["label"] == F.col("_k"), "left").drop("_k")
    out = out.join(ends.select(F.col("node").alias("_n"), "chain_end"), out["label"] == F.col("_n"), "left").drop("_n")
    out = out.withColumn("_end", F.coalesce("chain_end", "label"))
    out = out.join(named(live, "label", "_chain"), F.col("_end") == F.col("_k"), "left").drop("_k")
    out = out.join(named(delegated, "label", "_delegated"), F.col("label") == F.col("_k"), "left").drop("_k")
    out = out.join(named(crosswalk, "label", "_crosswalk"), F.col("_end") == F.col("_k"), "left").drop("_k")
    ways = {"live": "_live", "chain": "_chain", "delegated": "_delegated", "crosswalk": "_crosswalk"}
    how = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(w)) for w, c in ways.items()), F.lit("unresolved"))
    return out.select("label", F.coalesce(*ways.values()).alias("target"), how.alias("how"))


def subject_errors(rows: DataFrame, subjects: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """rows (label) with subject_id, enum and error: unknown label, retired, wrong enum, or null where all is well."""
    known = subjects.select("label", "subject_id", "retired", "enum")
    error = F.when(F.col("subject_id").isNull(), "unknown label").when(F.col("retired"), "retired").when(~F.col("enum").isin(*allowed), "wrong enum")
    return rows.join(known, "label", "left").withColumn("error", error)


def delegated_usage(resolved: DataFrame, usage: DataFrame) -> DataFrame:
    """label, target, files, datasets: usage (label, files, datasets) of the labels that are delegated elsewhere."""
    return resolved.where("how = 'delegated'").join(usage, "label").select("label", "target", "files", "datasets")


def unresolved_usage(resolved: DataFrame, usage: DataFrame) -> DataFrame:
    """label, files, datasets: usage of the labels that nothing answers for, and of those that were never looked up."""
    known = resolved.where("target is not null").select("label")
    return usage.join(known, "label", "left_anti").select("label", "files", "datasets")


def usage_rollup(live: DataFrame, resolved: DataFrame, usage: DataFrame) -> DataFrame:
    """target, files, datasets, labels: usage (label, files, datasets) summed over the labels that resolve to a term.

    Every live target has a row; labels is the sorted list of contributing labels, joined by |. Datasets are summed per
    label, so one that holds two labels counts twice.
    """
    found = resolved.where("how <> 'delegated' and target is not null").join(usage, "label")
    sums = found.groupBy("target").agg(F.sum("files").alias("f"), F.sum("datasets").alias("d"), F.array_join(F.array_sort(F.collect_list("label")), "|").alias("l"))
    zero = F.lit(0).cast("long")
    out = live.select("target").distinct().join(sums, "target", "left")
    return out.select("target", F.coalesce("f", zero).alias("files"), F.coalesce("d", zero).alias("datasets"), F.coalesce("l", F.lit("")).alias("labels"))


def first_rows(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The first row of each key: a drop of duplicates whose survivor is defined."""
    keys = [key] if isinstance(key, str) else key
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", number).where("_n = 1").drop("_n")
