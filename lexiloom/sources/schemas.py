"""Schema modules as relations: one nested document to classes, inheritance, slots, overrides, rules, values and annotations.

A module's YAML becomes JSON text in a task; everything after that is one typed parse and projections of it. Maps keep the
order in which a document lists its entries, which inheritance, rules and values depend on. What no relation knows stays as
JSON text where it stood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import durable

#: The slots of a value or class that hold mappings to other vocabularies.
MAPPING_SLOTS = ("exact_mappings", "close_mappings", "broad_mappings", "narrow_mappings", "related_mappings")

_CONDITIONS = "map<string, struct<equals_string: string, equals_number: string, value_presence: string>>"
_BRANCHES = f"array<struct<slot_conditions: {_CONDITIONS}>>"
_RULE = (
    f"struct<preconditions: struct<slot_conditions: {_CONDITIONS}, any_of: {_BRANCHES}>,"
    f" postconditions: struct<slot_conditions: {_CONDITIONS}, all_of: {_BRANCHES}, exactly_one_of: {_BRANCHES}>>"
)
_MAPPINGS = ", ".join(f"{s}: array<string>" for s in MAPPING_SLOTS)
#: What a slot says, in its own definition or where a class overrides it.
SLOT = (
    "description: string, range: string, required: boolean, recommended: boolean, multivalued: boolean, identifier: boolean, inlined: boolean,"
    " pattern: string, any_of: array<struct<range: string>>, examples: array<struct<value: string>>"
)
_VALUE = f"struct<meaning: string, description: string, in_subset: array<string>, see_also: array<string>, annotations: map<string, variant>, {_MAPPINGS}>"
_CLASS = f"struct<is_a: string, mixins: array<string>, description: string, slots: array<string>, slot_usage: map<string, struct<{SLOT}>>, rules: array<{_RULE}>, {_MAPPINGS}>"
DOCUMENT = (
    f"struct<annotations: map<string, string>, imports: array<string>, classes: map<string, {_CLASS}>, slots: map<string, struct<{SLOT}>>,"
    f" enums: map<string, struct<description: string, permissible_values: map<string, {_VALUE}>>>>"
)


@dataclass(frozen=True)
class Schema:
    """The relations of all modules. `ord` counts from 0 in the order of the document.

    modules (module, layer, error); imports (module, import); classes (module, class, ord, is_a, description); edges
    (class, parent, ord: 0 for is_a, then the mixins); listed (class, slot, ord); usage (class, slot, override: struct);
    slots (module, slot, ord, definition: struct); conditions (class, rule_no, side, ord, slot, test, value); values
    (module, enum, label, ord, meaning, description, subsets, see_also, annotations); mappings (module, enum, label, slot,
    ord, object).
    """

    modules: DataFrame
    imports: DataFrame
    classes: DataFrame
    edges: DataFrame
    listed: DataFrame
    usage: DataFrame
    slots: DataFrame
    conditions: DataFrame
    values: DataFrame
    mappings: DataFrame


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """module, document (JSON text), error of every YAML file under path. A file that is no YAML mapping has an error and no document."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for batch in batches:
            out = []
            for text in batch["value"]:
                try:
                    found = yaml.safe_load(text)
                    out.append((json.dumps(found, default=str), None) if isinstance(found, dict) else (None, "no mapping"))
                except yaml.YAMLError as wrong:
                    out.append((None, " ".join(str(wrong).split())))
            yield pd.DataFrame({"module": batch["module"], "document": [d for d, _ in out], "error": [e for _, e in out]}, dtype=object)

    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.ya?ml$", "").alias("module"), "value")
    return files.mapInPandas(parse, "module string, document string, error string")


def _entries(rows: DataFrame, what: str | Column, name: str, *keep: str) -> DataFrame:
    """keep, ord, name and body of a map's entries, in the order in which they are listed."""
    return rows.select(*keep, F.posexplode(F.map_entries(what)).alias("ord", "_e")).select(*keep, F.col("ord").cast("long").alias("ord"), F.col("_e.key").alias(name), F.col("_e.value").alias("body"))


def _keys(branches: Column) -> Column:
    """The conditions of a list of branches in order, as entries."""
    return F.flatten(F.transform(F.coalesce(branches, F.array()), lambda b: F.coalesce(F.map_entries(b["slot_conditions"]), F.array())))


def relations(documents: DataFrame, layer: str) -> Schema:
    """The relations of documents (module, document, maybe error). `layer` is the annotation that numbers a module's layer.

    Texts are parsed once, and what is parsed is written, so each relation is a projection of it. A layer that is no whole
    number, a document that is none and a parse error are told in modules; such a module still gives what it has.
    """
    error = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
    parsed = durable(documents.select("module", error.alias("error"), F.from_json("document", DOCUMENT).alias("d")), "schema").select("module", "error", "d.*")
    # {layer: 2} and {layer: {value: 2}} say the same
    said = F.col("annotations")[layer]
    number = F.coalesce(F.get_json_object(said, "$.value"), said)
    whole = F.when(number.rlike(r"^-?\d+$"), number.cast("long"))
    modules = parsed.select("module", whole.alias("layer"), F.coalesce("error", F.when(whole.isNull(), "the layer is no whole number")).alias("error"))
    classes = _entries(parsed, "classes", "class", "module")
    is_a = classes.where("body.is_a is not null").select("class", F.col("body.is_a").alias("parent"), F.lit(0).cast("long").alias("ord"))
    mixed = classes.select("class", F.posexplode("body.mixins").alias("at", "parent")).select("class", "parent", (F.col("at") + 1).cast("long").alias("ord"))
    listed = classes.select("class", F.posexplode("body.slots").alias("at", "slot")).select("class", "slot", F.col("at").cast("long").alias("ord"))
    usage = _entries(classes.select("class", "body"), "body.slot_usage", "slot", "class").select("class", "slot", F.col("body").alias("override"))
    slots = _entries(parsed, "slots", "slot", "module").select("module", "slot", "ord", F.col("body").alias("definition"))
    rules = classes.select("class", F.posexplode("body.rules").alias("rule_no", "rule"))
    pre, post = F.col("rule.preconditions"), F.col("rule.postconditions")
    own = lambda c: F.coalesce(F.map_entries(c["slot_conditions"]), F.array())
    sides = {"pre": own(pre), "any": _keys(pre["any_of"]), "post": F.concat(own(post), _keys(post["all_of"])), "one": _keys(post["exactly_one_of"])}
    tag = lambda side: lambda e, at: F.struct(F.lit(side).alias("side"), at.cast("long").alias("ord"), e["key"].alias("slot"), e["value"].alias("c"))
    tagged = F.concat(*(F.transform(entries, tag(side)) for side, entries in sides.items()))
    conditions = rules.select("class", F.col("rule_no").cast("long").alias("rule_no"), F.explode(tagged).alias("t")).select("class", "rule_no", "t.*")
    test = F.when(F.col("c.equals_string").isNotNull(), "equals").when(F.col("c.equals_number").isNotNull(), "number").when(F.col("c.value_presence").isNotNull(), "presence")
    conditions = conditions.select("class", "rule_no", "side", "ord", "slot", test.alias("test"), F.coalesce("c.equals_string", "c.equals_number", "c.value_presence").alias("value"))
    values = _entries(_entries(parsed, "enums", "enum", "module").select("module", "enum", "body"), "body.permissible_values", "label", "module", "enum")
    mapped = lambda slot: lambda o, at: F.struct(F.lit(slot).alias("slot"), at.cast("long").alias("ord"), o.alias("object"))
    found = F.flatten(F.array(*(F.transform(F.coalesce(F.col(f"body.{s}"), F.array()), mapped(s)) for s in MAPPING_SLOTS)))
    return Schema(
        modules, parsed.select("module", F.explode("imports").alias("import")), classes.select("module", "class", "ord", "body.is_a", "body.description"), is_a.unionByName(mixed), listed, usage, slots, conditions,
        values.select("module", "enum", "label", "ord", "body.meaning", "body.description", F.col("body.in_subset").alias("subsets"), "body.see_also", "body.annotations"),
        values.select("module", "enum", "label", F.explode(found).alias("m")).select("module", "enum", "label", "m.*"),
    )


def read_schema(spark: SparkSession, path: str, layer: str) -> Schema:
    return relations(read_documents(spark, path), layer)
