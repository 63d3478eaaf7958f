"""Reports over matches, pairs and gaps, and counts over mappings, requests and modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import blank, finding_id
from lexiloom.operators.project import NONE_FOUND


def mapping_report(queries: DataFrame, found: DataFrame, best: int = 3) -> DataFrame:
    """query_id, matches, ontologies, max_similarity (unrounded, 0.0 without matches) and listed, for every query (id).

    found: (query_id, target_id, part, rank, similarity). Of each ontology (part) the first `best` ranks count; they are
    listed by their score to 4 places, then ontology and rank, as target=score joined by ;.
    """
    kept = found.where(F.col("rank") <= best).withColumn("shown", F.round("similarity", 4))
    entry = F.struct((-F.col("shown")).alias("order"), "part", "rank", F.col("target_id").alias("target"))
    rows = kept.groupBy("query_id").agg(
        F.count("*").alias("matches"), F.count_distinct("part").alias("ontologies"), F.max("similarity").alias("most"), F.array_sort(F.collect_list(entry)).alias("entries")
    )
    listed = F.array_join(F.transform("entries", lambda e: F.format_string("%s=%.4f", e["target"].cast("string"), -e["order"])), ";")
    zero = F.lit(0).cast("long")
    return queries.select(F.col("id").alias("query_id")).join(rows, "query_id", "left").select(
        "query_id", F.coalesce("matches", zero).alias("matches"), F.coalesce("ontologies", zero).alias("ontologies"), F.coalesce("most", F.lit(0.0)).alias("max_similarity"), F.coalesce(listed, F.lit("")).alias("listed")
    )


def mapping_totals(report: DataFrame) -> DataFrame:
    """total_terms, terms_with_matches, without_percent of a mapping report."""
    matched = F.count_if(F.col("matches") > 0)
    return report.agg(F.count("*").alias("total_terms"), matched.alias("terms_with_matches"), F.round(100.0 * (F.count("*") - matched) / F.count("*"), 1).alias("without_percent"))


def pair_report(pairs: DataFrame) -> DataFrame:
    """id, subjects, similarity (4 places), crosses_categories, recommendation of pairs (id1, id2, sid1, sid2, ...).

    The id does not depend on the order of a pair; its subjects are sorted.
    """
    subjects = F.array_join(F.array_sort(F.array("sid1", "sid2")), ",")
    pair = finding_id("sim", F.col("id1"), F.col("id2"), ordered=False)
    return pairs.select(pair.alias("id"), subjects.alias("subjects"), F.round("similarity", 4).alias("similarity"), F.col("crosses").alias("crosses_categories"), "recommendation")


def pair_totals(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("total_pairs"), F.count_if("crosses").alias("cross_category"), F.count_if(F.col("recommendation") == "merge").alias("merges"), F.max("similarity").alias("most")
    )


def mapping_counts(rows: DataFrame) -> DataFrame:
    """what, name, n of mapping rows (subject, predicate, fit): by predicate, by fit where there is one, and distinct subjects."""
    named = lambda what, column: rows.where(blank(F.col(column)) != "").groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    subjects = rows.agg(F.count_distinct("subject").alias("n")).select(F.lit("subjects").alias("what"), F.lit("").alias("name"), "n")
    return named("predicate", "predicate").unionByName(named("fit", "fit")).unionByName(subjects)


def roundtrip_summary(rows: DataFrame, member: str, related: str, banned: tuple[str, ...], set_denoting: tuple[str, ...], attributes: tuple[str, ...]) -> DataFrame:
    """members, related, sets, attributes: how many mapping rows (predicate, object) are of each kind."""
    predicate, object_id = F.col("predicate"), F.col("object")
    count = lambda bad, name: F.count_if(bad).alias(name)
    return rows.agg(
        count((predicate == member) & (object_id != NONE_FOUND), "members"), count(predicate == related, "related"),
        count(predicate.isin(*banned) & object_id.isin(*set_denoting), "sets"), count(predicate.isin(*banned) & object_id.isin(*attributes), "attributes"),
    )


def request_stats(requests: DataFrame, rejections: DataFrame) -> DataFrame:
    """what, n: requests (kind, labels) by kind and the labels they ask for; rejections (terms) and the terms in them."""
    asked = requests.agg(
        F.count_if(F.col("kind") == "new_term").alias("new terms"), F.count_if(F.col("kind") == "modification").alias("modifications"), F.coalesce(F.sum("labels"), F.lit(0)).alias("proposed labels")
    )
    refused = rejections.agg(F.count("*").alias("rejection groups"), F.coalesce(F.sum(F.size(F.coalesce("terms", F.array().cast("array<string>")))), F.lit(0)).alias("rejected terms"))
    long = lambda df: df.unpivot([], df.columns, "what", "n")
    return long(asked.select(*(F.col(f"`{c}`").cast("long").alias(c) for c in asked.columns))).unionByName(long(refused.select(*(F.col(f"`{c}`").cast("long").alias(c) for c in refused.columns))))


def terms_by_category(terms: DataFrame) -> DataFrame:
    """category, n, listed: terms (category, name, row_no) of each category in their order, joined by |; none is uncategorized."""
    category = F.coalesce(F.nullif(blank(F.col("category")), F.lit("")), F.lit("uncategorized"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "name"))), lambda s: s["name"])
    return terms.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.array_join(ordered, "|").alias("listed"))


def module_members(subjects: DataFrame) -> DataFrame:
    """module, kinds, n: what a module holds: subjects (sid, kind, module, retired), modules and retired ones aside."""
    rows = subjects.where("kind <> 'module' and not retired")
    return rows.groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"), F.count("*").alias("n"))


def current_state(terms: DataFrame) -> DataFrame:
    """enum, total, mapped, annotated, retired, first_id, last_id of terms (enum, id, mappings, element_type, retired).

    Retired terms count as such alone.
    """
    live = ~F.col("retired")
    return terms.groupBy("enum").agg(
        F.count_if(live).alias("total"), F.count_if(live & (F.size("mappings") > 0)).alias("mapped"), F.count_if(live & (blank(F.col("element_type")) != "")).alias("annotated"),
        F.count_if(F.col("retired")).alias("retired"), F.min(F.when(live, F.col("id"))).alias("first_id"), F.max(F.when(live, F.col("id"))).alias("last_id"),
    )


def vocabulary_stats(terms: DataFrame) -> DataFrame:
    """total, types, mapped, mapped_percent, not_applicable of terms (category, mapped, not_applicable): one row, one pass.

    A null flag is false; mapped_percent is a whole number, 0 for no terms.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    mapped, total = F.count_if(flag("mapped")), F.count("*")
    percent = F.coalesce(F.round(F.try_divide(100 * mapped, total)).cast("long"), F.lit(0).cast("long"))
    return terms.agg(total.alias("total"), F.count_distinct("category").alias("types"), mapped.alias("mapped"), percent.alias("mapped_percent"), F.count_if(flag("not_applicable")).alias("not_applicable"))


def frequency_totals(counts: DataFrame, seeds: DataFrame) -> DataFrame:
    """what, n of counts (label, n) and seeds (label): total (of counts), labels, unseeded (labels without a seed), unused (seeds without a count)."""
    named = lambda what, df, n=F.count("*"): df.agg(F.coalesce(n, F.lit(0)).alias("n")).select(F.lit(what).alias("what"), "n")
    out = named("total", counts, F.sum("n")).union(named("labels", counts.select("label").distinct()))
    return out.union(named("unseeded", counts.join(seeds, "label", "left_anti"))).union(named("unused", seeds.join(counts, "label", "left_anti")))


#: Levels of overview() by what grouping_id(kind, enum, layer, predicate) says: a bit for each column that is not grouped by.
LEVELS = {15: "all", 7: "kind", 11: "enum", 5: "layer", 14: "predicate"}


def overview(subjects: DataFrame, predicates: dict[str, str], member: str, related: str, prefix: str, none_found: str) -> DataFrame:
    """level, kind, enum, layer, predicate, n, mapped, annotated, with_class, retired, first_id, last_id, rows: the whole state in one pass.

    subjects: (kind, enum, layer, term_id, retired, mappings: array of predicate, object, modifier). Levels are grouping
    sets over one scan: all, kind, enum (of terms), layer (of each kind), predicate (those given, by the name they have
    there). A positive row is one whose modifier is not Not. A subject is mapped if it has one, annotated if it has a
    `member` row or a `related` row to an object of the prefix, and has a class if a member row names an object. rows
    counts positive rows. Retired subjects count as such alone; ids are those of live terms. At the level predicate n counts
    subjects, and the other counts are 0.
    """
    kind = subjects.schema["mappings"].dataType.simpleString()
    positive = F.filter(F.coalesce("mappings", F.array().cast(kind)), lambda m: F.coalesce(m["modifier"], F.lit("")) != "Not")
    rows = subjects.withColumn("_rows", F.when(F.col("retired"), F.array().cast(kind)).otherwise(positive)).withColumn("_live", ~F.col("retired"))
    is_member = lambda m: m["predicate"] == member
    is_term = F.col("kind") == "term"
    # a row for the subject itself, and one for each predicate that it has rows of
    own = F.struct(F.lit(None).cast("string").alias("predicate"), F.size("_rows").alias("m"), F.lit(True).alias("own"))
    of = lambda predicate: F.size(F.filter("_rows", lambda m: m["predicate"] == predicate))
    each = [F.struct(F.lit(name).alias("predicate"), of(p).alias("m"), F.lit(False).alias("own")) for p, name in predicates.items()]
    rows = rows.select(
        "kind", F.when(is_term, F.col("enum")).alias("enum"), "layer", "retired", F.when(is_term & F.col("_live"), F.col("term_id")).alias("term_id"), "_live", (F.size("_rows") > 0).alias("mapped"),
        F.exists("_rows", lambda m: is_member(m) | ((m["predicate"] == related) & m["object"].startswith(prefix))).alias("annotated"), F.exists("_rows", lambda m: is_member(m) & (m["object"] != none_found)).alias("with_class"),
        F.explode(F.filter(F.array(own, *each), lambda e: e["own"] | (e["m"] > 0))).alias("e"),
    )
    found = subjects.sparkSession.sql(
        """
        SELECT grouping_id(kind, enum, layer, predicate) AS g, kind, enum, layer, predicate, count_if(own AND _live) AS n, count_if(own AND _live AND mapped) AS mapped, count_if(own AND _live AND annotated) AS annotated,
               count_if(own AND _live AND with_class) AS with_class, count_if(own AND retired) AS retired, min(term_id) AS first_id, max(term_id) AS last_id, sum(IF(own, m, 0)) AS rows, count_if(NOT own) AS with_predicate, sum(IF(own, 0, m)) AS of_predicate
        FROM {rows} GROUP BY GROUPING SETS ((), (kind), (enum), (kind, layer), (predicate))
        """,
        rows=rows.select("kind", "enum", "layer", "retired", "term_id", "_live", "mapped", "annotated", "with_class", "e.predicate", "e.m", "e.own"),
    )
    level = F.element_at(F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair)), F.col("g").cast("int"))
    found = found.withColumn("level", level).where("not (level = 'enum' and enum is null) and not (level = 'predicate' and predicate is null)")
    by_predicate = F.col("level") == "predicate"
    alone = lambda c: F.when(by_predicate, 0).otherwise(F.col(c)).alias(c)
    return found.select(
        "level", "kind", "enum", "layer", "predicate", F.when(by_predicate, F.col("with_predicate")).otherwise(F.col("n")).alias("n"), alone("mapped"), alone("annotated"), alone("with_class"), alone("retired"),
        F.when(~by_predicate, F.col("first_id")).alias("first_id"), F.when(~by_predicate, F.col("last_id")).alias("last_id"), F.when(by_predicate, F.col("of_predicate")).otherwise(F.col("rows")).alias("rows"),
    )


def slot_order(slots: DataFrame) -> DataFrame:
    """slots (class, slot, identifier, required, recommended) with `place`: identifiers first, then required, recommended, names."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).desc()
    return slots.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(flag("identifier"), flag("required"), flag("recommended"), "slot")))


def nested(rows: DataFrame, key: Column, name: str, *columns: str) -> DataFrame:
    """key and a JSON list of its rows, in the order of `columns`: how a report nests what tables keep flat."""
    return rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias(name))
