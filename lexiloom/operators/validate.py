"""Checks as tables of violations (rule, severity, subject, message): a check passes where its table is empty."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import blank, pipe_list
from lexiloom.operators.project import NONE_FOUND

Check = Callable[[], DataFrame]


def violation(rows: DataFrame, rule: str, subject: Column, message: Column | str, severity: str = "error") -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), text.alias("message"))


def rows_where(rows: DataFrame, rule: str, bad: Column, subject: str, message: Column | str, severity: str = "error") -> DataFrame:
    """A violation for each row of which `bad` holds."""
    return violation(rows.where(F.coalesce(bad, F.lit(False))), rule, F.col(subject), message, severity)


def duplicates(rows: DataFrame, rule: str, *key: str) -> DataFrame:
    """A violation for each key that several rows have."""
    found = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    return violation(found, rule, F.concat_ws("|", *key), F.format_string("%d rows", F.col("_n")))


def conflicts(rows: DataFrame, rule: str, key: str, value: str) -> DataFrame:
    """A violation for each key with several values."""
    found = rows.groupBy(key).agg(F.count_distinct(value).alias("_n")).where("_n > 1")
    return violation(found, rule, F.col(key), F.format_string("%d values", F.col("_n")))


def missing_from(rows: DataFrame, rule: str, column: str, known: DataFrame, name: str) -> DataFrame:
    """A violation for each distinct value that the known table lacks; nulls are not values."""
    found = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    return violation(found.join(known.select(F.col(name).alias("_v")), "_v", "left_anti"), rule, F.col("_v"), f"not in {name}")


def in_both(a: DataFrame, b: DataFrame, rule: str, column: str) -> DataFrame:
    """A violation for each value that two tables share but may not."""
    return violation(a.select(column).intersect(b.select(column)), rule, F.col(column), "in both")


def reconcile(a: DataFrame, b: DataFrame, rule: str, column: str) -> DataFrame:
    """Values of either table that the other lacks."""
    return missing_from(a, f"{rule}-left", column, b, column).union(missing_from(b, f"{rule}-right", column, a, column))


def required_if(rows: DataFrame, rule: str, subject: str, condition: Column, *needed: str) -> DataFrame:
    """Where the condition holds, the needed columns are not null."""
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in needed))), ",")
    return rows_where(rows, rule, condition & (missing != ""), subject, F.concat(F.lit("missing "), missing))


def exactly_one(rows: DataFrame, rule: str, subject: str, *columns: str) -> DataFrame:
    n = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))
    return rows_where(rows, rule, n != 1, subject, F.format_string("%d of " + ",".join(columns), n))


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """rule, n: a row for every check, also those without violations. Each check is counted before they meet."""
    counted = [rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, rows in checks.items()]
    return reduce(DataFrame.unionByName, counted)


# Mapping rows: subject_id, subject_label, predicate_id, object_id, object_label, fit, predicate_modifier, category.
# Predicates and fits of the mapping files.
PREDICATES = ("skos:exactMatch", "skos:closeMatch", "skos:broadMatch", "skos:narrowMatch", "skos:relatedMatch", "vocab:has_element_type")
FITS = ("exact", "broad", "approximate", "not_applicable")


@dataclass(frozen=True)
class MappingPolicy:
    """What mapping rows may say. Empty lists switch the rules off that need them."""

    member: str = "vocab:has_element_type"
    related: str = "skos:relatedMatch"
    banned: tuple[str, ...] = ()
    licensed: tuple[str, ...] = ()  # objects of which the banned predicates are allowed
    attributes: tuple[str, ...] = ()  # objects that are for facet values, not for content terms
    content: tuple[str, ...] = ()  # enums of content terms, the only ones with members
    prefix: str = ""  # what an object of a member starts with
    categories: tuple[str, str] | None = None  # of subjects and objects


MAPPING_RULES = (
    "subject-live", "subject-label", "modifier", "duplicate", "predicate", "none-found", "object-live", "object-label", "banned", "fit", "fit-negated", "fit-elsewhere", "fit-conflict", "member-and-related",
)
#: Rules that need the terms' enums (live: enum), the policy's lists, or the rows' categories.
POLICY_RULES = ("member-content", "member-object", "attribute-content", "subject-category", "object-category", "none-and-member")


def mapping_violations(rows: DataFrame, live: DataFrame, objects: DataFrame, policy: MappingPolicy) -> DataFrame:
    """Violations of the rules for mapping rows. live: (subject_id, subject_label), maybe enum; objects: (object_id, object_label).

    Rows meet live terms and objects once; each row then gives an array of the rules that it breaks. Rules about
    repeated rows and about all rows of a subject take an aggregation each.
    """
    modifier, fit, object_id = blank(F.col("predicate_modifier")), blank(F.col("fit")), F.col("object_id")
    positive, is_member, none = modifier != "Not", F.col("predicate_id") == policy.member, object_id == NONE_FOUND
    enum = F.col("enum") if "enum" in live.columns else F.lit(None).cast("string")
    labels = live.select(F.col("subject_id").alias("_s"), F.col("subject_label").alias("_label"), enum.alias("_enum")).dropDuplicates(["_s"])
    names = objects.select(object_id.alias("_o"), F.col("object_label").alias("_name")).dropDuplicates(["_o"])
    known = rows.join(labels, F.col("subject_id") == F.col("_s"), "left").join(names, object_id == F.col("_o"), "left")
    content, attribute = F.col("_enum").isin(*policy.content), object_id.isin(*policy.attributes)
    never = F.lit(False)
    rules = {
        "subject-live": (F.col("_s").isNull(), "subject is not live"),
        "subject-label": (F.col("_label") != F.col("subject_label"), "label differs"),
        "modifier": (~modifier.isin("", "Not"), "unknown modifier"),
        "predicate": (~F.col("predicate_id").isin(*PREDICATES), "unknown predicate"),
        "none-found": (none & ~(is_member & (fit == "not_applicable")), "NoTermFound needs membership and not_applicable"),
        "object-live": (~none & F.col("_o").isNull(), "object is not live"),
        "object-label": (F.col("_name") != F.col("object_label"), "object label differs"),
        "banned": (F.col("predicate_id").isin(*policy.banned) & ~object_id.isin(*policy.licensed) if policy.banned else never, "predicate is banned for this object"),
        "fit": (is_member & positive & ~fit.isin(*FITS), "fit out of range"),
        "fit-negated": (~positive & (fit != ""), "a negated row has no fit"),
        "fit-elsewhere": (~is_member & (fit != ""), "only membership has a fit"),
        "member-content": (is_member & ~content if policy.content else never, "only content terms have members"),
        "member-object": (is_member & ~none & ~object_id.startswith(policy.prefix) if policy.prefix else never, "membership needs an object of the target, or none found"),
        "attribute-content": (attribute & content if policy.attributes and policy.content else never, "attributes are for facet values"),
    }
    if policy.categories:
        for column, want in zip(("subject_category", "object_category"), policy.categories, strict=True):
            wanted = F.when(attribute, "").otherwise(want) if policy.attributes else F.lit(want)
            rules[column.replace("_", "-")] = (~none & object_id.startswith(policy.prefix) & (blank(F.col(column)) != wanted), "not the one category")
    hits = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message"))) for rule, (bad, message) in rules.items())))
    broken = known.select(F.col("subject_id"), F.explode(hits).alias("hit"))
    out = broken.select("hit.rule", F.lit("error").alias("severity"), F.col("subject_id").cast("string").alias("subject"), "hit.message")
    out = out.unionByName(duplicates(rows.withColumn("_m", modifier), "duplicate", "subject_id", "predicate_id", "object_id", "_m"))
    per = rows.groupBy("subject_id").agg(
        F.count_distinct(F.when(is_member & positive, F.col("fit"))).alias("fits"), F.bool_or(is_member & positive & ~none).alias("member"),
        F.bool_or((F.col("predicate_id") == policy.related) & positive).alias("related"), F.bool_or(is_member & positive & none).alias("none"),
    )
    for rule, bad, message in (
        ("fit-conflict", F.col("fits") > 1, "several fits"), ("member-and-related", F.col("member") & F.col("related"), "both a member and related"), ("none-and-member", F.col("member") & F.col("none"), "both a member and none found"),
    ):
        out = out.unionByName(rows_where(per, rule, bad, "subject_id", message))
    return out


def counted(violations: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """rule, n: a row for each of these rules, also for those without violations."""
    names = violations.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    found = violations.groupBy("rule").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(found, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


def still_there(rows: DataFrame, rule: str, column: str, live: DataFrame, name: str) -> DataFrame:
    """A violation for each distinct value that should have gone from the live table."""
    found = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    return violation(found.join(live.select(F.col(name).alias("_v")), "_v", "left_semi"), rule, F.col("_v"), f"still in {name}")


def id_checks(values: DataFrame, pattern: str) -> DataFrame:
    """Rules for values (enum, label, meaning): an identifier is there, has the vocabulary's form, and is the only one."""
    name = F.concat_ws("/", "enum", "label")
    rows = values.withColumn("_name", name).withColumn("_id", blank(F.col("meaning")))
    again = rows.where("_id <> ''").groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1")
    return (
        rows_where(rows, "id-missing", F.col("_id") == "", "_name", "no identifier")
        .unionByName(rows_where(rows, "id-form", (F.col("_id") != "") & ~F.col("_id").rlike(pattern), "_name", F.col("_id")))
        .unionByName(violation(again, "id-repeated", F.col("_id"), F.format_string("%d values", F.col("_n"))))
    )


def slot_objects(values: DataFrame, prefix: str, allowed: tuple[str, ...]) -> DataFrame:
    """A violation for each object of values (subject, slot, object) that may not stand in a mapping slot."""
    bad = F.startswith(F.col("object"), F.lit(prefix)) & ~F.col("object").isin(*allowed)
    return rows_where(values, "slot-object", bad, "subject", F.concat_ws(" in ", "object", "slot"))


def projection_gaps(have: DataFrame, want: DataFrame, negated: DataFrame) -> DataFrame:
    """Schema mappings (subject, slot, object) that no mapping row accounts for, and rows that the schema lacks.

    A mapping that a negated row names may go, so it is no gap.
    """
    key = ["subject", "slot", "object"]
    orphans = have.select(key).distinct().join(want.select(key), key, "left_anti").join(negated.select(key), key, "left_anti")
    missing = want.select(key).distinct().join(have.select(key), key, "left_anti")
    text = F.concat_ws(" ", "slot", "object")
    return violation(orphans, "projection-orphan", F.col("subject"), text).unionByName(violation(missing, "projection-missing", F.col("subject"), text))


def foreign_subjects(axioms: DataFrame, prefix: str) -> DataFrame:
    """A violation for each statement whose subject belongs to the target ontology."""
    return rows_where(axioms, "foreign-subject", F.startswith(F.col("subject"), F.lit(prefix)), "subject", "a target's term is a subject")


def unresolved_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """A violation for each import (module, import) that names no module (module)."""
    known = modules.select(F.col("module").alias("import")).distinct()
    return violation(imports.join(known, "import", "left_anti"), "import", F.col("module"), F.concat(F.lit("no module "), F.col("import")))


def facet_base_checks(rows: DataFrame, ends: DataFrame, pools: DataFrame) -> DataFrame:
    """Decomposition rows (term, pool, base): a base is there, and its chain (ends: node, chain_end) ends in its own pool.

    pools: (pool, name) of live terms. Which pool counts is told by the column that was filled, here `pool`.
    """
    based = rows.where(blank(F.col("base")) != "")
    reached = based.join(ends.select(F.col("node").alias("base"), "chain_end"), "base", "left").withColumn("name", F.coalesce("chain_end", "base"))
    return rows_where(rows, "facet-no-base", blank(F.col("base")) == "", "term", "no base").unionByName(
        violation(reached.join(pools.select("pool", "name").distinct(), ["pool", "name"], "left_anti"), "facet-unresolved", F.col("term"), F.concat(F.lit("base "), "base"))
    )


def facet_operation_errors(operations: DataFrame, terms: DataFrame, axes: DataFrame, decomposed: DataFrame, referenced: DataFrame, content: tuple[str, ...]) -> DataFrame:
    """Facet decisions (id, subject, base, axis, value), one row an axis, against what they may say.

    terms: (sid, enum); axes: (axis, enum); decomposed: (subject); referenced: (subject, place). A term and its base are
    content terms, and not the same; an axis is known; a value is of the axis's enum; the term is not decomposed yet, and
    nothing but a decomposition's base refers to it.
    """
    enum = lambda key, name: terms.select(F.col("sid").alias(key), F.col("enum").alias(name))
    rows = operations.join(enum("subject", "_own"), "subject", "left").join(enum("base", "_base"), "base", "left").join(enum("value", "_value"), "value", "left")
    rows = rows.join(axes.select("axis", F.col("enum").alias("_axis")), "axis", "left")
    rows = rows.join(decomposed.select("subject").distinct().withColumn("_done", F.lit(True)), "subject", "left")
    rows = rows.join(referenced.where("place <> 'facet base'").select("subject").distinct().withColumn("_used", F.lit(True)), "subject", "left")
    is_content = lambda c: F.coalesce(F.col(c).isin(*content), F.lit(False))
    checks = {
        "not a content term": ~(is_content("_own") & is_content("_base")), "its own base": F.col("subject") == F.col("base"), "no facet": F.col("axis").isNull(),
        "unknown axis": F.col("axis").isNotNull() & F.col("_axis").isNull(), "value of another enum": F.col("_axis").isNotNull() & ~F.coalesce(F.col("_value") == F.col("_axis"), F.lit(False)),
        "already decomposed": F.col("_done").isNotNull(), "still referenced": F.col("_used").isNotNull(),
    }
    hits = F.array_compact(F.array(*(F.when(bad, F.lit(error)) for error, bad in checks.items())))
    return rows.select("id", F.explode(hits).alias("error")).distinct()


def cross_moves(moves: DataFrame, terms: DataFrame, referenced: DataFrame, content: tuple[str, ...]) -> DataFrame:
    """id, error of moves (id, subject, enum) between content and other enums of terms (sid, enum) that tables refer to."""
    rows = moves.join(terms.select(F.col("sid").alias("subject"), F.col("enum").alias("_own")), "subject")
    crossing = rows.where(F.col("_own").isin(*content) != F.col("enum").isin(*content))
    used = referenced.where(F.col("place").startswith("facet") | F.col("place").startswith("scope")).groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("place")), ",").alias("_places"))
    return crossing.join(used, "subject").select("id", F.concat(F.lit("referenced by "), "_places").alias("error"))


def record_violations(rows: DataFrame, key: str, required: tuple[str, ...] = (), enums: dict[str, tuple[str, ...]] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """Rules for records: required columns, closed lists of values, patterns, and one record for each key. One pass, but for the keys."""
    checks = {f"required-{c}": blank(F.col(c).cast("string")) == "" for c in required}
    checks |= {f"range-{c}": F.col(c).isNotNull() & ~F.col(c).isin(*values) for c, values in (enums or {}).items()}
    checks |= {f"pattern-{c}": F.col(c).isNotNull() & ~F.col(c).rlike(p) for c, p in (patterns or {}).items()}
    hits = F.array_compact(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in checks.items())))
    broken = rows.select(F.col(key).cast("string").alias("subject"), F.explode(hits).alias("rule"))
    out = broken.select("rule", F.lit("error").alias("severity"), "subject", F.lit("record").alias("message"))
    return out.unionByName(duplicates(rows.where(F.col(key).isNotNull()), "identifier", key))


def provenance_errors(reports: DataFrame, fingerprint: str, model: str) -> DataFrame:
    """report, error of reports (report, fingerprint, source_hash, model): each gate in turn, the first that fails."""
    error = (
        F.when(~F.coalesce(F.col("fingerprint") == fingerprint, F.lit(False)), "schema fingerprint differs")
        .when(blank(F.col("source_hash")) == "", "no source hash")
        .when(~F.coalesce(F.col("model") == model, F.lit(False)), "another model")
    )
    return reports.withColumn("error", error).where("error is not null").select("report", "error")


def element_type_checks(terms: DataFrame, live_objects: DataFrame) -> dict[str, DataFrame]:
    """terms (term, element_type: |-joined, fit): each listed object is live; a fit is there where objects are."""
    listed = terms.select("term", "fit", F.explode(pipe_list(F.col("element_type"))).alias("object")).where("object <> 'not_applicable'")
    return {
        "element-live": missing_from(listed, "element-live", "object", live_objects, "object"),
        "element-fit": rows_where(listed, "element-fit", ~blank(F.col("fit")).isin(*FITS), "term", "fit out of range"),
    }


def element_forms(terms: DataFrame) -> DataFrame:
    """A violation for each listed object of terms (term, element_type) that is no CURIE."""
    listed = terms.select("term", F.explode(pipe_list(F.col("element_type"))).alias("object")).where("object <> 'not_applicable'")
    return rows_where(listed, "element-form", ~F.col("object").rlike(r"^[A-Za-z]+:\S+$"), "term", F.col("object"))


def subjectless(findings: DataFrame) -> DataFrame:
    """A violation for each finding (source, rule, subjects: array) that names no subject: none, or only empty ones. Its subject is the source."""
    named = F.exists(F.coalesce("subjects", F.array().cast("array<string>")), lambda s: blank(s) != "")
    return rows_where(findings, "finding-subject", ~F.coalesce(named, F.lit(False)), "source", F.concat(F.lit("no subject: "), F.coalesce("rule", F.lit(""))))


def stale(built: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that a fresh build has and the stored table lacks (+), and the other way round (-), repeats counted."""
    return built.exceptAll(stored).withColumn("side", F.lit("+")).union(stored.exceptAll(built).withColumn("side", F.lit("-")))


def operation_errors(operations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Decisions (id, kind, verdict, given: array of fields) against verdicts (kind, verdict, required, optional)."""
    joined = operations.join(verdicts, ["kind", "verdict"], "left")
    lacking = F.array_except("required", "given")
    extra = F.array_except("given", F.array_union("required", "optional"))
    error = (
        F.when(F.col("required").isNull(), "unknown verdict")
        .when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(lacking), ",")))
        .when(F.size(extra) > 0, F.concat(F.lit("unknown field "), F.array_join(F.array_sort(extra), ",")))
    )
    return joined.withColumn("error", error).where("error is not null").select("id", "kind", "verdict", "error")
