"""The verdicts that a curator may record, the types of their fields, and decisions checked against both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import blank
from lexiloom.operators.project import NONE_FOUND
from lexiloom.operators.schema import variant_fields, variant_kind
from lexiloom.operators.validate import FITS, MappingPolicy

_SLOTS = "choice:exact_mappings|close_mappings|broad_mappings|narrow_mappings|related_mappings"
_FIT = "choice:exact|broad|approximate|not_applicable"

# Kind, verdict, what applying it writes, required fields and optional fields with their types.
VERDICTS: list[tuple[str, str, str, dict[str, str], dict[str, str]]] = [
    ("term", "keep", "none", {}, {}),
    ("term", "keep_atomic", "none", {}, {}),
    ("term", "edit_description", "src", {"description": "str"}, {}),
    ("term", "rename", "src+refs", {"label": "str"}, {}),
    ("term", "set_subsets", "src", {"subsets": "sids:subset"}, {}),
    ("term", "move_to_enum", "src+refs", {"enum": "sid:enum"}, {}),
    ("term", "merge", "src+refs", {"into": "sid:term", "mappings": "choice:move|drop"}, {}),
    ("term", "delete", "src+refs", {}, {}),
    ("term", "facet", "src+refs", {"base": "sid:term", "facets": "map"}, {}),
    ("term", "adopt_mapping", "sssom", {"predicate": "str", "object": "str"}, {"object_label": "str", "element_type_fit": _FIT, "comment": "str"}),
    ("term", "reject_mapping", "sssom", {"predicate": "str", "object": "str"}, {"object_label": "str", "comment": "str"}),
    ("term", "add_see_also", "src", {"target": "sid:term"}, {}),
    ("term", "remove_see_also", "src", {"target": "sid:term"}, {}),
    ("term", "promote_tier", "src", {}, {}),
    ("term", "mint_base", "none", {}, {"from_labels": "str_list", "note": "str"}),
    ("term", "defer", "none", {}, {}),
    ("enum", "keep", "none", {}, {}),
    ("enum", "edit_description", "src", {"description": "str"}, {}),
    ("enum", "add_term", "src", {"label": "str"}, {"description": "str", "subsets": "sids:subset"}),
    ("enum", "rename_enum", "src+refs", {"name": "str"}, {}),
    ("enum", "move_enum", "src", {"module": "sid:module"}, {}),
    ("enum", "delete_enum", "src", {}, {}),
    ("enum", "defer", "none", {}, {}),
    ("class", "keep", "none", {}, {}),
    ("class", "edit_description", "src", {"description": "str"}, {}),
    ("class", "rename_class", "src+refs", {"name": "str"}, {}),
    ("class", "add_slot", "src", {}, {"slot": "sid:slot", "new_slot": "map"}),
    ("class", "drop_slot", "src", {"slot": "sid:slot"}, {"delete_def": "bool"}),
    ("class", "move_slot", "src", {"slot": "sid:slot", "to": "sid:class"}, {}),
    ("class", "set_slot_usage", "src", {"slot": "sid:slot", "usage": "map"}, {}),
    ("class", "add_rule", "src", {"rule": "map"}, {}),
    ("class", "edit_rule", "src", {"rule_sha1": "str", "rule": "map"}, {}),
    ("class", "drop_rule", "src", {"rule_sha1": "str"}, {}),
    ("class", "set_is_a", "src", {"is_a": "sid:class?"}, {}),
    ("class", "set_lineage", "src", {}, {"source": "str?", "conforms_to": "str_list", "see_also": "str_list"}),
    ("class", "adopt_mapping", "src", {"predicate": _SLOTS, "object": "str"}, {}),
    ("class", "reject_mapping", "src", {"predicate": _SLOTS, "object": "str"}, {}),
    ("class", "delete_class", "src", {}, {}),
    ("class", "defer", "none", {}, {}),
    ("slot", "keep", "none", {}, {}),
    ("slot", "edit_description", "src", {"description": "str"}, {}),
    ("slot", "rename_slot", "src+refs", {"name": "str"}, {}),
    ("slot", "retype_slot", "src", {}, {"range": "str?", "inlined": "bool", "any_of": "list"}),
    ("slot", "set_cardinality", "src", {}, {"required": "bool", "recommended": "bool", "multivalued": "bool"}),
    ("slot", "set_examples", "src", {"examples": "list"}, {}),
    ("slot", "adopt_mapping", "src", {"predicate": _SLOTS, "object": "str"}, {}),
    ("slot", "reject_mapping", "src", {"predicate": _SLOTS, "object": "str"}, {}),
    ("slot", "delete_slot", "src+refs", {}, {}),
    ("slot", "defer", "none", {}, {}),
    ("usage", "keep", "none", {}, {}),
    ("usage", "edit_usage", "src", {"usage": "map"}, {}),
    ("usage", "drop_usage", "src", {}, {}),
    ("usage", "defer", "none", {}, {}),
    ("subset", "keep", "none", {}, {}),
    ("subset", "edit_description", "src", {"description": "str"}, {}),
    ("subset", "rename_subset", "src", {"name": "str"}, {}),
    ("subset", "merge_subset", "src", {"into": "sid:subset"}, {}),
    ("subset", "delete_subset", "src", {}, {}),
    ("subset", "defer", "none", {}, {}),
    ("module", "keep", "none", {}, {}),
    ("module", "edit_description", "src", {"description": "str"}, {}),
    ("module", "set_layer", "src", {"layer": "int"}, {}),
    ("module", "defer", "none", {}, {}),
]
# Verdicts of which exactly one group of fields is given, by any of its fields; verdicts that only a seed records.
ONE_OF = {
    ("class", "add_slot"): (("slot",), ("new_slot",)),
    ("class", "set_lineage"): (("source", "conforms_to", "see_also"),),
    ("slot", "retype_slot"): (("range", "any_of"),),
    ("slot", "set_cardinality"): (("required", "recommended", "multivalued"),),
}
SEED_ONLY = (("term", "mint_base"),)


def verdict_table(spark: SparkSession) -> DataFrame:
    """kind, verdict, terminal, writes, required, optional, one_of, seed_only of every verdict; all but defer are terminal."""
    rows = [(k, v, v != "defer", w, list(need), list(may), [list(g) for g in ONE_OF.get((k, v), ())], (k, v) in SEED_ONLY) for k, v, w, need, may in VERDICTS]
    return spark.createDataFrame(rows, "kind string, verdict string, terminal boolean, writes string, required array<string>, optional array<string>, one_of array<array<string>>, seed_only boolean")


def field_types(spark: SparkSession) -> DataFrame:
    """kind, verdict, field, type, of (the kind that ids name, or null for any), choices, nullable of every field."""
    rows = []
    for kind, verdict, _, need, may in VERDICTS:
        for field, said in (need | may).items():
            plain = said.removesuffix("?")
            name, _, more = plain.partition(":")
            rows.append((kind, verdict, field, name, more if name in ("sid", "sids") and more else None, more.split("|") if name == "choice" else [], said.endswith("?")))
    return spark.createDataFrame(rows, "kind string, verdict string, field string, type string, of string, choices array<string>, nullable boolean")


def verdict_errors(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """id, error: decisions (id, kind, verdict, given: array of fields, rationale) against the verdicts of their kind.

    A terminal verdict needs a rationale; exactly one group of one_of is given, by any of its fields.
    """
    rows = decisions.join(F.broadcast(verdicts), ["kind", "verdict"], "left")
    lacking, extra = F.array_except("required", "given"), F.array_except("given", F.array_union("required", "optional"))
    groups = F.size(F.filter("one_of", lambda g: F.arrays_overlap(g, F.col("given"))))
    listed = lambda fields: F.array_join(F.array_sort(fields), ",")
    errors = F.array_compact(
        F.array(
            F.when(F.col("writes").isNull(), F.lit("unknown verdict")), F.when(F.size(lacking) > 0, F.concat(F.lit("missing "), listed(lacking))),
            F.when(F.size(extra) > 0, F.concat(F.lit("unknown field "), listed(extra))), F.when((F.size("one_of") > 0) & (groups != 1), F.lit("one group of fields")),
            F.when(F.col("terminal") & (blank(F.col("rationale")) == ""), F.lit("no rationale")),
        )
    )
    return rows.select("id", F.explode(errors).alias("error"))


def _type_error(value: Column, kind: Column) -> Column:
    """What is wrong with a field's value (a variant of this kind) by the type of its row; null where nothing is."""
    text = F.expr("try_variant_get(value, '$', 'string')")
    texts = F.expr("try_variant_get(value, '$', 'array<variant>')")
    is_text = lambda v: (variant_kind(v) == "string") & (F.length(F.trim(v.cast("string"))) > 0)
    all_texts = F.coalesce(F.forall(texts, is_text), F.lit(False))
    right = {
        "str": (kind == "string") & (F.trim(text) != ""), "bool": kind == "boolean", "int": kind == "bigint", "map": kind == "object", "list": kind == "array", "str_list": (kind == "array") & all_texts,
        "sid": kind == "string", "sids": (kind == "array") & all_texts, "choice": (kind == "string") & F.array_contains("choices", text),
    }
    said = {"choice": F.concat(F.lit("not one of "), F.array_join("choices", "|"))}
    wrong = F.lit(None).cast("string")
    for name, good in right.items():
        wrong = F.when((F.col("type") == name) & ~F.coalesce(good, F.lit(False)), said.get(name, F.lit(f"no {name}"))).otherwise(wrong)
    return F.when(kind == "void", F.when(~F.col("nullable"), F.lit("null"))).otherwise(wrong)


def operation_errors(decisions: DataFrame, subjects: DataFrame) -> DataFrame:
    """id, field, error of decisions (id, kind, verdict, rationale, origin, operation: JSON text) by verdicts and field types.

    subjects: (sid, kind, live). Each field of an operation is a row that meets its type; ids in fields are rows that meet
    the subjects, whatever their number. Told are: what verdict_errors tells, an operation that is no object or names
    another verdict, a verdict that only a seed records, values of the wrong type, nulls where none may stand, and ids
    that name no subject, one of another kind, or one that is not live. An absent operation has no fields.
    """
    spark = decisions.sparkSession
    parsed = decisions.withColumn("value", F.expr("try_parse_json(coalesce(operation, '{}'))"))
    shaped = F.coalesce(variant_kind(F.col("value")) == "object", F.lit(False))
    out = parsed.where(~shaped).select("id", F.lit(None).cast("string").alias("field"), F.lit("the operation is no object").alias("error"))
    fields = variant_fields(parsed.where(shaped), "id", "kind", "verdict")
    named = fields.where("key = 'op'").where(~F.coalesce(F.expr("try_variant_get(value, '$', 'string')") == F.col("verdict"), F.lit(False)))
    out = out.unionByName(named.select("id", F.lit("op").alias("field"), F.lit("names another verdict").alias("error")))
    fields = fields.where("key <> 'op'").withColumnRenamed("key", "field")
    given = fields.groupBy("id").agg(F.collect_set("field").alias("given"))
    rows = parsed.where(shaped).select("id", "kind", "verdict", "rationale", "origin").join(given, "id", "left").withColumn("given", F.coalesce("given", F.array().cast("array<string>")))
    table = verdict_table(spark)
    whole = verdict_errors(rows, table)
    seeds = rows.join(F.broadcast(table.where("seed_only")), ["kind", "verdict"]).where(blank(F.col("origin")) != "seed")
    whole = whole.unionByName(seeds.select("id", F.lit("only a seed records this").alias("error")))
    out = out.unionByName(whole.select("id", F.lit(None).cast("string").alias("field"), "error"))
    typed = fields.join(F.broadcast(field_types(spark)), ["kind", "verdict", "field"]).withColumn("error", _type_error(F.col("value"), variant_kind(F.col("value"))))
    out = out.unionByName(typed.where("error is not null").select("id", "field", "error"))
    named = typed.where("error is null and type in ('sid', 'sids')").where(variant_kind(F.col("value")) != "void")
    ids = F.when(F.col("type") == "sid", F.array(F.expr("try_variant_get(value, '$', 'string')"))).otherwise(F.expr("try_variant_get(value, '$', 'array<string>')"))
    named = named.select("id", "field", "of", F.explode(F.array_distinct(ids)).alias("sid"))
    known = subjects.select("sid", F.col("kind").alias("is_a"), "live").dropDuplicates(["sid"])
    wrong = (
        F.when(F.col("is_a").isNull(), F.concat(F.lit("no subject "), "sid"))
        .when(F.col("of").isNotNull() & (F.col("is_a") != F.col("of")), F.concat("sid", F.lit(" is a "), "is_a"))
        .when(~F.coalesce("live", F.lit(False)), F.concat("sid", F.lit(" is not live")))
    )
    met = named.join(known, "sid", "left").withColumn("error", wrong)
    return out.unionByName(met.where("error is not null").select("id", "field", "error"))


def mapping_operation_errors(decisions: DataFrame, policy: MappingPolicy) -> DataFrame:
    """id, error: what decisions (id, verdict, operation: JSON text) that adopt or reject a mapping of a term may not say.

    Membership needs an object of the target and, if adopted, a fit; a banned predicate may not be adopted for a target's
    object but for those licensed or attributes; a fit belongs to membership alone, and none found to membership and
    not_applicable.
    """
    get = lambda name: F.get_json_object("operation", f"$.{name}")
    rows = decisions.where(F.col("verdict").isin("adopt_mapping", "reject_mapping")).select("id", (F.col("verdict") == "reject_mapping").alias("negate"), get("predicate").alias("predicate"), get("object").alias("object"), get("element_type_fit").alias("fit"))
    member, target, none = F.col("predicate") == policy.member, F.startswith(F.col("object"), F.lit(policy.prefix)), F.col("object") == NONE_FOUND
    fit = blank(F.col("fit"))
    checks = {
        "membership needs an object of the target": member & ~target & ~none,
        "membership needs a fit": member & ~F.col("negate") & ~fit.isin(*FITS),
        "the predicate is banned for this object": F.col("predicate").isin(*policy.banned) & target & ~F.col("negate") & ~F.col("object").isin(*policy.licensed, *policy.attributes),
        "only membership has a fit": (fit != "") & ~member,
        "none found needs membership and not_applicable": none & ~(member & (fit == "not_applicable")),
    }
    hits = F.array_compact(F.array(*(F.when(bad, F.lit(error)) for error, bad in checks.items())))
    return rows.select("id", F.explode(hits).alias("error"))
