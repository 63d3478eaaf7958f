import pytest
from pyspark.sql import functions as F

from lexiloom.sources import sinks, tables

STANZAS = """format-version: 1.2

[Term]
id: SO:1
name: enhancer
def: "A \\"strong\\" region." [x:y]
synonym: "booster" EXACT []
synonym: "enh" RELATED []
is_a: SO:9 ! region

[Typedef]
id: part_of
name: part of

[Term]
id: SO:2
name: old
is_obsolete: true

[Term]
id: SO:3
name: bare
def: no quotes
"""

OWL = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o" xmlns:obo="b">
<owl:Class rdf:about="http://x/obo/AB_0001"><rdfs:label>one</rdfs:label><obo:IAO_0000115>first</obo:IAO_0000115></owl:Class>
<owl:Class rdf:about="http://x/obo/AB_0002"><rdfs:label>two</rdfs:label><owl:deprecated>true</owl:deprecated></owl:Class>
<owl:Class rdf:about="http://x/obo/AB_0003"></owl:Class></rdf:RDF>"""

VOCABULARY = """enums:
  A:
    permissible_values:
      peaks: {description: called peaks, meaning: "ab:AB_0000001", in_subset: [p, q], see_also: ["ab:AB_0000002"]}
      reads:
  B:
    permissible_values:
      zones: {meaning: "ab:AB_0000002"}
"""


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_tsv(spark, tmp_path):
    a = write(tmp_path, "a.tsv", '# note\nsubject_id\tobject_id\tcomment\nx\ty\t"said ""so"""\nz\t\t\n')
    b = write(tmp_path, "b.tsv", "subject_id\tobject_id\tpredicate_modifier\nw\tv\tNot\n")
    rows = tables.read_mappings(spark, a, b).orderBy("file", "row_no").collect()
    assert [(r.subject_id, r.object_id, r.comment, r.predicate_modifier) for r in rows] == [("x", "y", 'said "so"', None), ("z", "", "", None), ("w", "v", None, "Not")]


def test_stanzas(spark, tmp_path):
    rows = tables.read_stanzas(spark, write(tmp_path, "so.obo", STANZAS), "so").orderBy("row_no").collect()
    assert [(r.id, r.name, r.definition) for r in rows] == [("SO:1", "enhancer", 'A \\"strong\\" region.'), ("SO:3", "bare", "no quotes")]
    assert [tuple(s) for s in rows[0].synonyms] == [("booster", "EXACT"), ("enh", "RELATED")] and rows[0].is_a == ["SO:9"]


def test_owl_and_union(spark, tmp_path):
    sources = {"so": write(tmp_path, "so.obo", STANZAS), "ab": write(tmp_path, "ab.owl", OWL)}
    rows = {(r.ontology, r.id): (r.name, r.definition) for r in tables.read_ontologies(spark, sources).collect()}
    assert rows[("ab", "AB:0001")] == ("one", "first") and rows[("ab", "AB:0003")] == ("AB:0003", "") and ("ab", "AB:0002") not in rows and len(rows) == 4


def test_vocabulary(spark, tmp_path):
    path = write(tmp_path, "v.yaml", VOCABULARY)
    rows = tables.read_vocabulary(spark, path, ("A", "B"), "ab").orderBy("row_no").collect()
    assert [(r.name, r.category, r.subset, r.term_id) for r in rows] == [("peaks", "A", "p", "AB_0000001"), ("reads", "A", "other", None), ("zones", "B", "other", "AB_0000002")]
    assert tables.read_enum_values(spark, path).count() == 3
    with pytest.raises(Exception, match="no term of this vocabulary"):
        tables.read_vocabulary(spark, path, ("A",), "cd").collect()


def test_decisions_are_checked(spark, tmp_path):
    good = "version: 1\nnext_id: 2\ndecisions:\n- {id: DEC-0001, subject: 'term:1', verdict: keep, status: applied, evidence: ['sim:1'], origin: {kind: seed}, applied: {on: 2024-01-01}}\n"
    row = tables.read_decisions(spark, write(tmp_path, "d.yaml", good)).first()
    assert (row.id, row.evidence, row.origin, row.applied_on) == ("DEC-0001", ["sim:1"], "seed", "2024-01-01")
    with pytest.raises(Exception, match="status"):
        tables.read_decisions(spark, write(tmp_path, "e.yaml", good.replace("applied,", "done,"))).collect()


def test_small_readers(spark, tmp_path):
    modules = "annotations: {layer: 2}\nclasses: {C: {}}\nslots: {s: {range: C}}\n"
    assert {(r.kind, r.name, r.layer) for r in tables.read_modules(spark, write(tmp_path, "m.yaml", modules), "layer").collect()} == {("class", "C", 2), ("slot", "s", 2)}
    assert tables.read_registry(spark, write(tmp_path, "r.json", '{"t:1": {"kind": "term", "label": "x"}}')).first().record["label"] == "x"
    assert tables.read_crosswalk(spark, write(tmp_path, "c.json", '{"labels": {"x": "T1"}}')).first().target == "T1"
    assert [r.term for r in tables.read_bullets(spark, write(tmp_path, "b.md", "# h\n- one two\n* no\n- three\n")).collect()] == ["one two", "three"]
    assert tables.read_policy(spark, write(tmp_path, "p.yaml", "a: [x, y]\nb: 3\n")).count() == 2
    asked = "requests:\n  SO:\n  - {id: R1, proposed_label: l, additional_labels: [a, b], motivating_terms: [{term: t}]}\n  - {id: R2, kind: modification, term: {label: m}}\n"
    assert {(r.id, r.label, r.labels, tuple(r.terms)) for r in tables.read_requests(spark, write(tmp_path, "q.yaml", asked)).collect()} == {("R1", "l", 3, ("t",)), ("R2", "m", 0, ())}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A", "p", "n" * 40, "d" * 120, "SO:1", 0.926), ("", None, "m", None, None, 0.0)], "category string, subset string, name string, definition string, best string, score double")
    lines = [r.value for r in sinks.report_markdown(rows).orderBy("c", "s", "level", "n").collect()]
    assert lines == ["## A", "### p (1 terms, max 0.93)", f"- **{'n' * 30}** SO:1 (0.93): {'d' * 100}...", "## Uncategorized", "### other (1 terms, max 0.00)", "- **m** - (0.00): "]
    sinks.write_lines(spark.createDataFrame([(k, str(k)) for k in range(30)], "k int, value string"), str(tmp_path / "lines"), "k")
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == [str(k) for k in range(30)]
    sinks.write_tsv(sinks.candidate_table(rows), str(tmp_path / "t"), "name")
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).where("score = '0.926'").count() == 1
    sinks.write_embeddings(spark.createDataFrame([(1, [1.0])], "id int, embedding array<double>"), str(tmp_path / "e"), {"model_name": "m1"})
    assert sinks.read_embeddings(spark, str(tmp_path / "e"), "m1").count() == 1
    with pytest.raises(ValueError, match="not of m2"):
        sinks.read_embeddings(spark, str(tmp_path / "e"), "m2")
    text = spark.createDataFrame([("a\n<b>\nold\n<e>\nz",), ("a",)], "t string").select(sinks.between_marks(F.col("t"), "<b>", "<e>", F.lit("new")).alias("t"))
    assert [r.t for r in text.collect()] == ["a\n<b>\nnew\n<e>\nz", "a\n<b>\nnew\n<e>\n"]
    assert '"provenance":{"v":"1"}' in sinks.report_json(rows, {"v": "1"}).first().value


def test_more_readers(spark, tmp_path):
    path = write(tmp_path, "so.obo", STANZAS)
    assert sorted(r.id for r in tables.live_ids(spark, path).collect()) == ["SO:1", "SO:3"] and "part_of" in {r.id for r in tables.live_ids(spark, path, terms_only=False).collect()}
    both = tables.read_ontologies(spark, {"so": path, "ab": write(tmp_path, "ab.owl", OWL)}).where("id in ('SO:1', 'AB:0001')").orderBy("ontology").collect()
    assert [r.synonyms for r in both] == [[], ["booster", "enh"]]
    assert tables.file_hashes(spark, path).first().hash.startswith("sha256:")
    values = tables.read_enum_values(spark, write(tmp_path, "v.yaml", VOCABULARY))
    assert {(r.term_id, r.label) for r in tables.term_places(values, "ab").collect()} == {("AB_0000001", "peaks"), ("AB_0000002", "zones")}
    with pytest.raises(ValueError, match="AB_0000001"):
        tables.term_places(values.union(values), "ab")
    report = '{"provenance": {"schema_fingerprint": "f1"}, "pairs": [{"id": "sim:1", "similarity": 0.9}, {"id": "sim:2"}]}'
    rows = tables.read_report(spark, write(tmp_path, "p.json", report), "pairs", "id: string, similarity: double").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("f1", "sim:1", 0.9), ("f1", "sim:2", None)]
    filled = tables.with_defaults(spark.createDataFrame([(None, None, None)], "a string, b array<string>, c int")).first()
    assert tuple(filled) == ("", [], None)
    assert tables.filled(spark.createDataFrame([(" ",), ("x",), (None,)], "a string"), "a").count() == 1


def test_all_stores_but_one(spark, tmp_path):
    for name in ("own", "so", "edam"):
        sinks.write_embeddings(spark.createDataFrame([(1, [1.0])], "id int, embedding array<double>"), str(tmp_path / "s" / name), {"model_name": "m1"})
    assert sorted(r.ontology for r in sinks.read_stores(spark, str(tmp_path / "s"), "own", "m1").collect()) == ["edam", "so"]
    with pytest.raises(FileNotFoundError):
        sinks.read_stores(spark, str(tmp_path / "s" / "own" / "vectors"), "own")


def test_frequencies_and_paging(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "term string, count long")
    assert [r.term for r in sinks.frequency_table(counts).collect()] == ["c", "a", "b"]
    seeds = spark.createDataFrame([("z",), ("a",)], "term string")
    assert [tuple(r) for r in sinks.frequency_table(counts, seeds).collect()] == [("a", "yes", 2), ("z", "no", 0)]
    assert tuple(counts.agg(F.count("*").alias("n")).select(sinks.envelope(F.col("n")).alias("e")).first().e) == (0, 100_000, 3, 1)


def test_reports(spark, tmp_path):
    pairs = spark.createDataFrame([("b", "c", "X", "X", 0.9, False, "hierarchy"), ("a", "d", "X", "Y", 0.95, True, "review")], "term1 string, term2 string, category1 string, category2 string, similarity double, crosses boolean, recommendation string")
    lines = [r.value for r in sinks.pair_markdown(pairs).orderBy("c", "n").collect()]
    assert lines[1:] == ["| a | d | 0.95 | **X/Y** | review |", "| b | c | 0.90 | X/X | hierarchy |", "## Across categories", "- **a** (X) <-> **d** (Y): 0.95"]
    assert sinks.pair_markdown(pairs.limit(0)).where("value like 'No pairs%'").count() == 1
    gaps = spark.createDataFrame([("p", "n2", "d" * 120, 0.4, "SO:1", "so"), ("p", "n1", None, 0.0, None, None), (None, "n3", "", 0.1, None, None)], "subset string, name string, definition string, max_similarity double, best string, ontology string")
    lines = [r.value for r in sinks.gap_markdown(gaps).orderBy("s", "level", "n").collect()]
    assert lines == ["### other (1 terms, max sim: 0.10)", "- **n3** (max sim: 0.10)", "### p (2 terms, max sim: 0.40)", "- **n1** (max sim: 0.00)", f"- **n2** (max sim: 0.40)\n  - Definition: {'d' * 100}...\n  - Best match: SO:1 (so, 0.40)"]
    sinks.write_report(pairs.agg(F.count("*").alias("total")), pairs, str(tmp_path / "r"), {"model": "m"}, "term1")
    head, rows = sinks.read_written_report(spark, str(tmp_path / "r"))
    assert head.first().total == 2 and head.first().provenance.model == "m" and [r.term1 for r in rows.collect()] == ["a", "b"]
    found = spark.createDataFrame([("t", "c", None, None, 1, "lexical", "SO:1", "l", "m", 0.98765, "d" * 400)], "term string, category string, subset string, existing_mapping string, rank int, match_kind string, match_id string, match_label string, matched_on string, score double, match_def string")
    out = sinks.candidates_written(found, "term")
    assert len(out.columns) == 11 and out.first().score == "0.988" and len(out.first().match_def) == 300 and out.first().subset == ""
