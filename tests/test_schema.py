"""From YAML modules to relations, effective slots, rules, checks and validated instances; nested walks; typed operations."""

import json

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import browse, schema, verdicts
from lexiloom.plans import catalog
from lexiloom.sources import schemas

CORE = """
annotations: {layer: {tag: layer, value: 2}}
imports: [types, base]
classes:
  Named:
    slots: [id, label]
  Audited:
    mixins: []
    slots: [label, note]
    slot_usage:
      label: {description: audited, required: true}
  File:
    is_a: Named
    mixins: [Audited]
    slots: [size, parts, kind]
    slot_usage:
      note: {pattern: "^[a-z ]+$"}
    close_mappings: ["x:File"]
    rules:
      - preconditions:
          slot_conditions: {kind: {equals_string: peaks}}
          any_of:
            - slot_conditions: {size: {value_presence: PRESENT}}
            - slot_conditions: {label: {equals_string: big}}
        postconditions:
          slot_conditions: {parts: {required: true}}
          all_of: [{slot_conditions: {note: {required: true}}}]
      - postconditions:
          exactly_one_of:
            - slot_conditions: {size: {}}
            - slot_conditions: {note: {}}
  Empty:
slots:
  id: {identifier: true, range: curie}
  label: {range: string}
  note: {}
  size: {range: integer, examples: [{value: "3"}]}
  parts: {range: File, multivalued: true, inlined: true}
  kind: {range: Kind}
"""
TERMS = """
annotations: {layer: 1}
enums:
  Kind:
    permissible_values:
      reads: {meaning: "v:2", see_also: ["v:1"], in_subset: [raw], annotations: {element_type: "SO:1|SO:2", element_type_fit: exact}, exact_mappings: ["e:9", "e:1"], broad_mappings: ["e:0"]}
      peaks: {meaning: "v:1", annotations: {element_type: ["SO:1"], element_type_fit: near}}
      bare:
      odd: {annotations: {element_type: "ED:1|SO:3"}}
"""


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("schema")
    for name, text in (("core", CORE), ("terms", TERMS), ("broken", "classes: [unclosed"), ("list", "- 1"), ("bare", "annotations: {layer: two}")):
        (folder / f"{name}.yaml").write_text(text)
    return schemas.read_schema(spark, str(folder), "layer")


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def test_modules_and_their_faults(read):
    found = {r.module: (r.layer, r.error) for r in read.modules.collect()}
    assert found["core"] == (2, None) and found["terms"] == (1, None) and found["bare"] == (None, "the layer is no whole number")
    assert found["list"] == (None, "no mapping") and "expected" in found["broken"][1]
    assert rows(read.imports, "module", "import") == [("core", "base"), ("core", "types")]


def test_classes_in_order(read):
    assert rows(read.classes, "ord", "class", "is_a") == [(0, "Named", None), (1, "Audited", None), (2, "File", "Named"), (3, "Empty", None)]
    assert rows(read.edges, "class", "parent", "ord") == [("File", "Audited", 1), ("File", "Named", 0)]
    assert rows(read.listed.where("class = 'File'"), "ord", "slot") == [(0, "size"), (1, "parts"), (2, "kind")]


def test_slots_by_inheritance_and_override(read):
    found = {(r["class"], r.slot): r for r in schema.effective_slots(read).collect()}
    assert {s for c, s in found if c == "File"} == {"id", "label", "note", "size", "parts", "kind"}
    label = found["File", "label"]  # a mixin hides the parent, with its own override
    assert (label.inherited_from, label.required) == ("Audited", True) and found["Named", "label"].required is False
    assert found["File", "id"].required and found["File", "parts"].multivalued and found["File", "kind"].range == "Kind"
    assert found["File", "note"].pattern is None  # shown as the class that lists it says
    refined = {(r["class"], r.slot): r.pattern for r in schema.effective_slots(read, refine_inherited=True).collect()}
    assert refined["File", "note"] == "^[a-z ]+$" and refined["Audited", "note"] is None


def test_rules_in_words(read):
    assert rows(browse.rule_summaries(read.conditions), "class", "rule_no", "summary", "slots") == [
        ("File", 0, 'When kind = "peaks" and size or label = "big": parts, note required.', "parts, note"),
        ("File", 1, "Exactly one of size / note is required.", "size, note"),
    ]


def test_values_with_annotations_and_mappings(spark, read):
    assert [r.label for r in read.values.orderBy("ord").collect()] == ["reads", "peaks", "bare", "odd"]
    assert rows(read.mappings, "label", "slot", "ord", "object") == [("reads", "broad_mappings", 0, "e:0"), ("reads", "exact_mappings", 0, "e:9"), ("reads", "exact_mappings", 1, "e:1")]
    live = spark.createDataFrame([("SO:1",)], "object string")
    assert rows(schema.annotation_violations(read.values, live, "SO:"), "rule", "subject", "message") == [
        ("annotation-fit", "Kind/odd", "annotations without a fit"), ("annotation-fit-range", "Kind/peaks", "fit near"), ("annotation-live", "Kind/odd", "SO:3"), ("annotation-live", "Kind/reads", "SO:2"),
        ("annotation-members", "Kind/peaks", "members are no text"), ("annotation-prefix", "Kind/odd", "ED:1"),
    ]


def test_instances(spark, read):
    model = schema.compiled(read)
    part = {"id": "f:2", "label": "part"}
    records = {
        "whole": {"id": "f:1", "label": "one", "note": "a b", "size": 3, "kind": "peaks", "parts": [part, {"id": "f:3", "label": "x", "parts": [part]}]},
        "minimal": {"id": "f:1", "label": "one", "note": None},
        "failing": {"label": 4, "note": "A1", "size": "3", "kind": "zebras", "colour": "red", "parts": [{"id": "no curie", "label": "x"}, "f:7", {"parts": part}]},
        "single": {"id": "f:1", "label": ["one"], "size": 1.5, "kind": {"a": 1}},
    }
    texts = [(k, json.dumps(v)) for k, v in records.items()] + [("text", "[1]"), ("broken", "{"), ("none", None)]
    found = schema.instance_violations(spark.createDataFrame(texts, "record string, document string"), model, "File")
    assert rows(found, "record", "path", "rule") == sorted(
        [
            ("failing", "$", "required"), ("failing", "$.colour", "unknown-slot"), ("failing", "$.kind", "enum"), ("failing", "$.label", "type"), ("failing", "$.note", "pattern"), ("failing", "$.parts[0].id", "form"),
            ("failing", "$.parts[2]", "required"), ("failing", "$.parts[2]", "required"), ("failing", "$.parts[2].parts", "list"), ("failing", "$.size", "type"),
            ("single", "$.kind", "type"), ("single", "$.label", "list"), ("single", "$.size", "type"), ("text", "$", "no-record"), ("broken", "$", "no-record"), ("none", "$", "no-record"),
        ],
        key=repr,
    )


def test_a_level_of_instances_is_written_once(spark, read, monkeypatch):
    model, written, durable = schema.compiled(read), [], schema.durable
    monkeypatch.setattr(schema, "durable", lambda df, name, *more: written.append(name) or durable(df, name, *more))
    deep = {"id": "f:1", "label": "a", "kind": "zebras", "size": 1, "note": "a", "parts": [{"id": "f:2", "label": None, "parts": [{"id": 3, "label": "c", "parts": []}]}]}
    found = schema.instance_violations(spark.createDataFrame([("deep", json.dumps(deep))], "record string, document string"), model, "File")
    assert rows(found, "path", "rule") == [("$.kind", "enum"), ("$.parts[0]", "required"), ("$.parts[0].parts[0].id", "type")]
    assert written.count("checked") == 3 and len(written) == 5  # and the compiled fields, and the values of their enums


def written_plans(monkeypatch, name):
    """Plans of the tables that durable() writes under a name from now on."""
    plans, durable = [], schema.durable
    monkeypatch.setattr(schema, "durable", lambda df, n, *more: plans.extend([df._jdf.queryExecution().executedPlan().toString()] * (n == name)) or durable(df, n, *more))
    return plans


def test_instances_are_opened_as_rows(spark, read, monkeypatch):
    """A value meets no function that is interpreted for each item, and no path that may lead nowhere: both cost some microseconds."""
    model, plans = schema.compiled(read), written_plans(monkeypatch, "checked")
    schema.instance_violations(spark.createDataFrame([("r", '{"id": "f:1"}')], "record string, document string"), model, "File")
    assert plans and all("lambdafunction" not in p and "$[0]" not in p for p in plans)


def test_null_and_empty_values_of_instances(spark, read):
    model = schema.compiled(read)
    texts = [("a", '{"id": null, "label": "x", "parts": [null, {}, []]}'), ("b", '{"id": "f:1", "label": "x", "parts": []}'), ("c", '{"id": "f:1", "label": "x", "parts": {}, "size": 3.0}')]
    found = schema.instance_violations(spark.createDataFrame(texts, "record string, document string"), model, "File")
    assert rows(found, "record", "path", "rule", "message") == sorted(
        [
            ("a", "$", "required", "missing id"), ("a", "$.parts[0]", "type", "void"), ("a", "$.parts[1]", "required", "missing id"), ("a", "$.parts[1]", "required", "missing label"), ("a", "$.parts[2]", "type", "array"),
            ("c", "$.parts", "list", "one value, not a list"), ("c", "$.size", "type", "decimal"),
        ],
        key=repr,
    )


def test_entries_at_any_depth(spark):
    document = {
        "so": {"requests": [{"id": 1, "motivating_terms": [{"term": "a", "category": "X"}, {"no": "term"}, "text", ["b"]], "deep": [[{"own_terms": [{"term": "b", "enum": "Y", "category": "Z"}]}]]}]},
        "motivating_terms": {"term": "not in a list"}, "other": [{"term": "c"}], "own_terms": [{"term": "d", "motivating_terms": [{"term": "a"}]}],
    }
    documents = spark.createDataFrame([("r", json.dumps(document)), ("bad", "{"), ("none", None), ("flat", "3")], "key_of string, document string")
    found = schema.nested_entries(documents, ("motivating_terms", "own_terms"), {"term": ("term",), "category": ("enum", "category")})
    assert rows(found, "path", "term", "category") == [
        ("$.own_terms[0]", "d", None), ("$.own_terms[0].motivating_terms[0]", "a", None), ("$.so.requests[0].deep[0][0].own_terms[0]", "b", "Y"), ("$.so.requests[0].motivating_terms[0]", "a", "X"),
    ]
    terms = spark.createDataFrame([("t1", "a", "X"), ("t2", "a", "Q"), ("t3", "b", "Z")], "subject string, label string, enum string")
    assert rows(schema.citing(found, terms), "subject", "path") == [("t1", "$.own_terms[0].motivating_terms[0]"), ("t1", "$.so.requests[0].motivating_terms[0]"), ("t2", "$.own_terms[0].motivating_terms[0]")]
    once = [("t1", "r"), ("t2", "r")]  # an entry without an enum and one with are one citation
    assert rows(schema.cited_in(found, terms), "subject", "key_of") == once
    twice = terms.unionByName(spark.createDataFrame([("t3", "b", "Y"), ("t1", "a", "R"), ("t1", "a", "X")], terms.schema))
    assert rows(schema.cited_in(found, twice), "subject", "key_of") == [*once, ("t3", "r")]
    empty = schema.nested_entries(documents.where("key_of = 'flat'"), ("a",), {"term": ("term",)})
    assert empty.columns == ["key_of", "path", "key", "term"] and empty.count() == 0


def test_documents_are_walked_as_rows(spark, monkeypatch):
    """A node meets no function that is interpreted for each item, and no path that may lead nowhere."""
    plans = written_plans(monkeypatch, "level")
    schema.nested_entries(spark.createDataFrame([("r", '{"own_terms": [{"term": "a"}]}')], "key_of string, document string"), ("own_terms",), {"term": ("term",)})
    assert plans and all("lambdafunction" not in p and "$.term" not in p for p in plans)


def test_entries_deeper_than_one_pass(spark):
    document = {"own_terms": [{"term": "t0"}]}
    for k in range(1, 12):
        document = {"in": [document], "own_terms": [{"term": f"t{k}"}]}
    found = schema.nested_entries(spark.createDataFrame([("r", json.dumps(document))], "key_of string, document string"), ("own_terms",), {"term": ("term",)})
    assert rows(found, "term", "path") == sorted((f"t{k}", "$" + ".in[0]" * (11 - k) + ".own_terms[0]") for k in range(12))


def test_a_citation_is_not_compared_with_others(spark):
    """Pairs of subject and request are as many as the product of a name's terms and requests: none of them is shuffled."""
    found = catalog.queries()["nested_citations"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == found.distinct().count() > 0 and plan.count("Aggregate") == 1  # of subjects with several labels


def test_citations_meet_lists_of_subjects(spark, monkeypatch):
    """A label's subjects come in lists of bounded length, and all of them are cited."""
    monkeypatch.setattr(schema, "_LIST", 4)
    written, durable = {}, schema.durable
    monkeypatch.setattr(schema, "durable", lambda df, name, *more: written.setdefault(name, durable(df, name, *more)))
    terms = spark.createDataFrame([(k, "a", "X" if k % 3 else "Y") for k in range(30)] + [(90, "b", "X"), (91, "b", "X"), (91, "a", "Y")], "subject int, label string, enum string")
    entries = spark.createDataFrame([("r", "a", None), ("r", "a", "Y"), ("q", "a", "Y"), ("q", "b", " ")], "key_of string, term string, category string")
    found = rows(schema.cited_in(entries, terms), "subject", "key_of")
    assert found == sorted([(k, "r") for k in range(30)] + [(k, "q") for k in range(0, 30, 3)] + [(90, "q"), (91, "q"), (91, "r")], key=repr)
    assert written["lists"].agg(F.max(F.size("subjects")), F.sum(F.size("subjects"))).first()[:] == (4, 31)


def decided(spark, *decisions):
    return spark.createDataFrame([(k, *d) for k, d in enumerate(decisions)], "id int, kind string, verdict string, rationale string, origin string, operation string")


def test_typed_operations(spark):
    subjects = spark.createDataFrame([("t:1", "term", True), ("t:2", "term", False), ("c:1", "class", True)], "sid string, kind string, live boolean")
    rows_of = decided(
        spark,
        ("term", "merge", "why", "x", '{"op": "merge", "into": "t:1", "mappings": "move"}'),  # 0: right
        ("term", "merge", "why", "x", '{"into": "t:2", "mappings": "keep", "more": 1}'),
        ("class", "set_is_a", "why", "x", '{"is_a": null}'),  # 2: may be null
        ("class", "set_is_a", " ", "x", '{"is_a": "t:1"}'),
        ("term", "set_subsets", "why", "x", '{"subsets": ["t:1", "zz"]}'),
        ("term", "set_subsets", "why", "x", '{"subsets": [null]}'),
        ("module", "set_layer", "why", "x", "{"),
        ("nothing", "keep", "why", "x", None),
        ("term", "keep", "why", "x", None),  # 8: no operation is right
        ("slot", "set_cardinality", "why", "x", '{"required": true, "multivalued": false}'),  # 9: one group
    )
    assert rows(verdicts.operation_errors(rows_of, subjects), "id", "field", "error") == sorted(
        [
            (1, None, "unknown field more"), (1, "into", "t:2 is not live"), (1, "mappings", "not one of move|drop"), (3, None, "no rationale"), (3, "is_a", "t:1 is a term"), (4, "subsets", "no subject zz"),
            (4, "subsets", "t:1 is a term"), (5, "subsets", "no sids"), (6, None, "the operation is no object"), (7, None, "unknown verdict"),
        ],
        key=repr,
    )


def test_every_verdict_has_types_that_are_known(spark):
    types = {r.type for r in verdicts.field_types(spark).select("type").distinct().collect()}
    assert types == {"str", "bool", "int", "map", "list", "str_list", "sid", "sids", "choice"}
    table = verdicts.verdict_table(spark)
    assert table.count() == table.select("kind", "verdict").distinct().count() == 63 and table.where("not terminal").agg(F.count("*")).first()[0] == 7
