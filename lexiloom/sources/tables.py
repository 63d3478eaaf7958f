"""Readers: term vocabularies, ontology stanzas, mapping and frequency tables, registries, decision logs.

Each file type becomes flat tables with an explicit row number. Large formats are split and parsed by Spark's own text,
CSV, JSON and XML readers; nested YAML, whose files are small, is parsed one file to a row in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import blank, term_pattern
from lexiloom.session import in_order


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A table with # comment lines and a header: all columns text, empty cells as empty text, with row_no and file.

    Quoting follows the usual CSV rule ("" inside quotes). Rows are numbered by file name and place in the file.
    """
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", escape='"', multiLine=False, inferSchema=False)
    names = rows.columns
    place = F.struct(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names), F.col("_metadata.file_name").alias("file"), place.alias("_place"))
    return in_order(rows, "row_no", 1, "_place").drop("_place")


def read_mappings(spark: SparkSession, *paths: str) -> DataFrame:
    """The union of mapping tables by column name, numbered by file and place; columns that a file lacks are null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (read_tsv(spark, p) for p in sorted(paths)))
    return in_order(rows.withColumnRenamed("row_no", "_row"), "row_no", 1, "file", "_row").drop("_row")


def read_stanzas(spark: SparkSession, path: str, ontology: str, keep_obsolete: bool = False) -> DataFrame:
    """Terms of an ontology in stanza format: ontology, id, name, definition, synonyms, is_a, namespace, row_no.

    The file is split at stanza heads, so it is read in parallel. Only [Term] stanzas count; obsolete and nameless ones
    are dropped; a definition is what stands in quotes before its sources, or the whole value; synonyms are
    (text, scope).
    """
    rows = spark.read.option("lineSep", "\n[").text(path).withColumn("row_no", F.monotonically_increasing_id())
    body = F.col("value")
    terms = rows.where(body.startswith("Term]"))
    first = lambda tag: F.nullif(F.trim(F.regexp_extract(body, rf"(?m)^{tag}: (.*)$", 1)), F.lit(""))
    raw = F.regexp_extract(body, r"(?m)^def: (.*)$", 1)
    quoted = F.regexp_extract(raw, r'^"(.*)"\s*\[', 1)
    texts, scopes = (F.regexp_extract_all(body, F.lit(r'(?m)^synonym: "(.*?)"\s+(\w+)'), F.lit(k)) for k in (1, 2))
    out = terms.select(
        F.lit(ontology).alias("ontology"), first("id").alias("id"), first("name").alias("name"), F.when(quoted != "", quoted).otherwise(F.trim(raw)).alias("definition"),
        F.zip_with(texts, scopes, lambda t, s: F.struct(t.alias("text"), s.alias("scope"))).alias("synonyms"),
        F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^is_a: (.*)$"), F.lit(1)), lambda x: F.trim(F.split(x, " ! ")[0])).alias("is_a"),
        F.coalesce(first("namespace"), F.lit("")).alias("namespace"), body.rlike(r"(?m)^is_obsolete: true\s*$").alias("obsolete"), "row_no",
    )
    out = out.where(F.col("name").isNotNull())
    return out if keep_obsolete else out.where("not obsolete").drop("obsolete")


def read_owl(spark: SparkSession, path: str, ontology: str) -> DataFrame:
    """Classes of an OWL file in RDF/XML: ontology, id (CURIE), name, definition; deprecated ones are dropped."""
    fields = "`_rdf:about` string, `rdfs:label` string, `obo:IAO_0000115` string, `owl:deprecated` string"
    rows = spark.read.format("xml").option("rowTag", "owl:Class").option("mode", "PERMISSIVE").schema(fields).load(path)
    about = F.regexp_extract("`_rdf:about`", "([^/#]+)$", 1)
    kept = rows.where(F.col("`_rdf:about`").isNotNull() & (F.lower(F.coalesce(F.col("`owl:deprecated`"), F.lit("false"))) != "true"))
    identity = F.regexp_replace(about, "^([A-Za-z]+)_", "$1:")
    return kept.select(
        F.lit(ontology).alias("ontology"), identity.alias("id"), F.coalesce(F.col("`rdfs:label`"), identity).alias("name"), F.coalesce(F.col("`obo:IAO_0000115`"), F.lit("")).alias("definition"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def read_ontologies(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """All ontologies of {name: path} as one table; a path that ends in .obo is in stanza format, any other is OWL."""
    shared = ("ontology", "id", "name", "definition", "row_no")
    texts = F.transform("synonyms", lambda s: s["text"]).alias("synonyms")
    stanzas = lambda name, path: read_stanzas(spark, path, name).select(*shared, texts)
    owl = lambda name, path: read_owl(spark, path, name).select(*shared, F.array().cast("array<string>").alias("synonyms"))
    return reduce(DataFrame.unionByName, ((stanzas if p.endswith(".obo") else owl)(n, p) for n, p in sources.items()))


def live_ids(spark: SparkSession, path: str, terms_only: bool = True) -> DataFrame:
    """id of what a stanza file does not call obsolete: of its terms, or of stanzas of any kind."""
    rows = spark.read.option("lineSep", "\n[").text(path)
    kind = F.col("value").startswith("Term]") if terms_only else F.col("value").rlike(r"^[A-Za-z]+\]")
    live = rows.where(kind & ~F.col("value").rlike(r"(?m)^is_obsolete: true"))
    return live.select(F.trim(F.regexp_extract("value", r"(?m)^id: (.*)$", 1)).alias("id")).where("id <> ''").distinct()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, hash: sha256: and the digest of each file's bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))


def read_yaml(spark: SparkSession, path: str, rows_of: Callable[[Any, str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that `rows_of(document, file)` makes of each YAML file under path; a file is parsed in one task."""
    names = [part.split()[0] for part in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            for file, text in zip(batch["file"], batch["value"], strict=True):
                yield pd.DataFrame(list(rows_of(yaml.safe_load(text) or {}, file)), columns=names, dtype=object)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.mapInPandas(parse, schema)


def read_vocabulary(spark: SparkSession, path: str, enums: tuple[str, ...], prefix: str) -> DataFrame:
    """Terms of the listed enums: name, definition, category, subset, term_id, see_also, row_no.

    subset is the first one, or "other". An identifier that is not one of the vocabulary's is an error.
    """
    import re

    pattern = re.compile(term_pattern(prefix))

    def terms(document: dict, _: str) -> Iterator[tuple]:
        number = 0
        for enum in enums:
            for name, body in ((document.get("enums") or {}).get(enum) or {}).get("permissible_values", {}).items():
                body = body or {}
                meaning = body.get("meaning")
                found = pattern.match(meaning) if meaning else None
                if meaning and not found:
                    raise ValueError(f"{enum}/{name}: {meaning!r} is no term of this vocabulary")
                subsets = body.get("in_subset") or ["other"]
                yield name, body.get("description") or "", enum, subsets[0], found[1] if found else None, body.get("see_also") or [], number
                number += 1

    return read_yaml(spark, path, terms, "name string, definition string, category string, subset string, term_id string, see_also array<string>, row_no long")


def read_enum_values(spark: SparkSession, path: str) -> DataFrame:
    """module, enum, label, meaning of every permissible value of every module under path."""

    def values(document: dict, file: str) -> Iterator[tuple]:
        for enum, body in (document.get("enums") or {}).items():
            for label, value in ((body or {}).get("permissible_values") or {}).items():
                yield file.rsplit(".", 1)[0], enum, label, (value or {}).get("meaning")

    return read_yaml(spark, path, values, "module string, enum string, label string, meaning string")


def term_places(values: DataFrame, prefix: str) -> DataFrame:
    """term_id, module, enum, label of enum values (see read_enum_values); an id on several values is an error."""
    found = values.withColumn("term_id", F.regexp_extract("meaning", term_pattern(prefix), 1)).where("term_id <> ''")
    again = [r["term_id"] for r in found.groupBy("term_id").count().where("count > 1").limit(5).collect()]
    if again:
        raise ValueError(f"identifiers on several values: {', '.join(sorted(again))}")
    return found.select("term_id", "module", "enum", "label")


def read_modules(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """module, layer, kind (class, slot, enum), name, range of every schema module; a layer that is no number is an error."""

    def parts(document: dict, file: str) -> Iterator[tuple]:
        module, number = file.rsplit(".", 1)[0], (document.get("annotations") or {}).get(layer)
        number = number.get("value") if isinstance(number, dict) else number
        if not isinstance(number, int):
            raise ValueError(f"{module}: the layer is no whole number")
        for kind in ("classes", "slots", "enums"):
            for name, body in (document.get(kind) or {}).items():
                yield module, number, {"classes": "class", "slots": "slot", "enums": "enum"}[kind], name, (body or {}).get("range")

    return read_yaml(spark, path, parts, "module string, layer long, kind string, name string, range string")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of records by id as rows: sid and the record's fields as a map."""
    text = spark.read.text(path, wholetext=True)
    records = F.from_json("value", "map<string, map<string, string>>")
    return text.select(F.explode(records).alias("sid", "record"))


def read_crosswalk(spark: SparkSession, path: str, key: str = "labels") -> DataFrame:
    """label, target of a JSON object of names by label."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json(F.get_json_object("value", f"$.{key}"), "map<string, string>")).alias("label", "target"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """id, subject, also_affects, verdict, rationale, evidence, status, origin, applied_on of a decision log.

    The log's shape is checked while it is read: numbers, unique ids DEC-0000, subjects, verdicts and known states.
    """
    import re

    def rows(document: dict, _: str) -> Iterator[tuple]:
        if not isinstance(document.get("version"), int) or not isinstance(document.get("next_id"), int) or not isinstance(document.get("decisions"), list):
            raise ValueError("a decision log has version, next_id and decisions")
        seen = set()
        for d in document["decisions"]:
            name = d.get("id")
            if not re.fullmatch(r"DEC-\d{4,}", str(name)) or name in seen:
                raise ValueError(f"{name}: no decision id, or not the only one")
            if not d.get("subject") or not d.get("verdict") or d.get("status") not in ("pending", "applied", "withdrawn"):
                raise ValueError(f"{name}: subject, verdict or status")
            seen.add(name)
            text = lambda v: None if v is None else str(v)
            origin, applied = d.get("origin") or {}, d.get("applied") or {}
            yield name, d["subject"], list(d.get("also_affects") or []), d["verdict"], text(d.get("rationale")), [text(e) for e in d.get("evidence") or []], d["status"], text(origin.get("kind")), text(applied.get("on", applied.get(True)))  # YAML reads a bare on as true

    return read_yaml(spark, path, rows, "id string, subject string, also_affects array<string>, verdict string, rationale string, evidence array<string>, status string, origin string, applied_on string")


def read_requests(spark: SparkSession, path: str, key: str = "requests") -> DataFrame:
    """ontology, id, kind, status, label, labels (how many it asks for), terms of requests to other ontologies."""

    def rows(document: dict, _: str) -> Iterator[tuple]:
        for ontology, items in (document.get(key) or {}).items():
            for r in items or []:
                kind = r.get("kind") or "new_term"
                label = r.get("proposed_label") or r.get("label") or (r.get("term") or {}).get("label")
                more = 0 if kind == "modification" else 1 + len(r.get("additional_labels") or [])
                yield ontology, r.get("id"), kind, r.get("status") or "proposed", label, more, [m.get("term") for m in r.get("motivating_terms") or []]

    return read_yaml(spark, path, rows, "ontology string, id string, kind string, status string, label string, labels long, terms array<string>")


def read_bullets(spark: SparkSession, path: str) -> DataFrame:
    """term of each line that starts with "- "."""
    return spark.read.text(path).select(F.regexp_extract("value", "^- (.+)$", 1).alias("term")).where("term <> ''")


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """list, value of every list of a policy file."""

    def rows(document: dict, _: str) -> Iterator[tuple]:
        for name, values in document.items():
            if isinstance(values, list):
                for v in values:
                    yield name, str(v)

    return read_yaml(spark, path, rows, "list string, value string")


def filled(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose cell holds more than white space."""
    return rows.where(blank(F.col(column)) != "")


def with_defaults(rows: DataFrame) -> DataFrame:
    """rows with empty texts and lists for null ones, as records are read from files that lack a field."""
    empty = {"string": F.lit("")}
    columns = []
    for field in rows.schema:
        kind = field.dataType.simpleString()
        default = F.array().cast(kind) if kind.startswith("array") else empty.get(kind)
        columns.append(F.col(f"`{field.name}`") if default is None else F.coalesce(F.col(f"`{field.name}`"), default).alias(field.name))
    return rows.select(*columns)


def read_report(spark: SparkSession, path: str, key: str, fields: str) -> DataFrame:
    """The list of records under `key` of a JSON report, with its provenance's schema_fingerprint."""
    text = spark.read.text(path, wholetext=True)
    records = F.from_json(F.get_json_object("value", f"$.{key}"), f"array<struct<{fields}>>")
    return text.select(F.get_json_object("value", "$.provenance.schema_fingerprint").alias("fingerprint"), F.explode(records).alias("r")).select("fingerprint", "r.*")
