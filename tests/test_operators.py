"""Behaviour on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.operators import browse, curation, lexical, project, resolve, similarity, validate

TERMS = [
    ("SO:0000165", "enhancer", None, 0), ("SO:0000167", "promoter", None, 1), ("SO:0000149", "contig", None, 2),
    ("SO:0001019", "copy_number_variation", ["copy number variation", "CNV"], 3), ("SO:0000694", "SNP", ["single nucleotide polymorphism"], 4), ("SO:0002307", "chromatin_loop", None, 5),
]
SCHEMA = "term_id string, name string, synonyms array<string>, row_no int"


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def hits(spark, asked, terms=TERMS):
    index = lexical.index(spark.createDataFrame(terms, SCHEMA))
    queries = spark.createDataFrame([(k, q) for k, q in enumerate(asked)], "query_id int, text string")
    return lexical.search(queries, index).orderBy("query_id", "hit_no").collect()


def test_text(spark):
    assert one(spark, text.normalize(F.col("a")), a="A/B  compartments\t!") == "a b compartments"
    assert one(spark, text.variants(F.col("a")), a="gRNAs") == ["grnas", "grna"]
    assert one(spark, text.variants(F.col("a")), a="its") == ["its"]
    assert one(spark, text.variants(F.col("a")), a="domain boundaries") == ["domain boundaries", "domain boundary"]
    forms = [tuple(x) for x in one(spark, text.token_suffixes(F.col("a")), a="candidate enhancers")]
    assert forms == [("candidate enhancers", 0), ("candidate enhancer", 0), ("enhancers", 1), ("enhancer", 1)]
    assert one(spark, text.token_suffixes(F.col("a")), a="") == []
    assert one(spark, text.has_word(F.col("a"), F.lit("male")), a="Male-derived") and not one(spark, text.has_word(F.col("a"), F.lit("male")), a="female")
    assert one(spark, text.finding_id("gap", F.col("a")), a="") is None
    assert one(spark, text.finding_id("sim", F.col("a"), F.col("b"), ordered=False), a="x", b="y") == one(spark, text.finding_id("sim", F.col("a"), F.col("b"), ordered=False), a="y", b="x")
    assert one(spark, text.iri(F.col("a"), {"ex": "http://e/"}), a="ex:") is None


@pytest.mark.parametrize(
    "asked, expected",
    [
        ("contigs", [("SO:0000149", "lexical", 0, "name")]),
        ("candidate enhancers", [("SO:0000165", "lexical-suffix", 1, "name")]),
        ("CNVs", [("SO:0001019", "lexical", 0, "synonym")]),
        ("copy number variation", [("SO:0001019", "lexical", 0, "name")]),
        ("chromatin loops", [("SO:0002307", "lexical", 0, "name")]),
        ("nonexistent widget thing", []),
        ("", []),
    ],
)
def test_lexical_search(spark, asked, expected):
    assert [(h.term_id, h.match_kind, h.suffix_start, h.label_kind) for h in hits(spark, [asked])] == expected


def test_lexical_priorities(spark):
    assert [h.term_id for h in hits(spark, ["candidate enhancers"], [*TERMS, ("X:1", "candidate enhancer", None, 9)])] == ["X:1"]
    assert [h.term_id for h in hits(spark, ["predicted enhancers"], [*TERMS, ("X:2", "enhancer", None, 9)])] == ["SO:0000165", "X:2"]
    assert len(hits(spark, ["enhancer"], [("X:3", "enhancers", ["enhancer"], 0)])) == 1


def test_blend(spark):
    terms = [("SO:0000165", "enhancer", None, 0), ("SO:0000110", "sequence_feature", None, 1), ("SO:0000001", "region", None, 2)]
    index = lexical.index(spark.createDataFrame(terms, SCHEMA))
    queries = spark.createDataFrame([(1, "candidate enhancers"), (2, "unrelated widget")], "query_id int, text string")
    scores = spark.createDataFrame([(q, t, s) for q in (1, 2) for t, s in zip(("SO:0000165", "SO:0000110", "SO:0000001"), (0.31, 0.8, 0.7))], "query_id int, term_id string, score double")
    rows = lexical.blend(lexical.search(queries, index), scores, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.term_id[-3:], r.match_kind) for r in rows] == [
        (1, 1, "165", "lexical-suffix"), (1, 2, "110", "embedding"), (1, 3, "001", "embedding"), (2, 1, "110", "embedding"), (2, 2, "001", "embedding")
    ]
    assert rows[0].score == 0.31
    with pytest.raises(KeyError):
        lexical.candidates_of(queries, lexical.blend(lexical.search(queries, index), scores, 2), "unknown")


def test_similarity(spark):
    terms = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.9, 0.1, 0.0])], "id long, embedding array<double>")
    targets = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0])], "id long, embedding array<double>")
    pairs = similarity.self_pairs(terms, 0.9).withColumn("what", similarity.recommendation(F.col("similarity"), F.lit(False))).collect()
    assert [(p.id1, p.id2, p.what) for p in pairs] == [(1, 3, "merge")]
    best = {r.query_id: (r.max_similarity, r.best_id) for r in similarity.best_match(terms, similarity.top_k(terms, targets, 5, 0.5)).collect()}
    assert best[1] == (1.0, 1) and best[2] == (0.0, None) and best[3][0] > 0.9
    assert similarity.top_k(terms.limit(0), targets, 5).count() == 0 and similarity.self_pairs(terms.limit(0), 0.5).count() == 0
    tied = spark.createDataFrame([(k, [1.0, 0.0, 0.0]) for k in (9, 4, 7)], "id long, embedding array<double>")
    assert [r.target_id for r in similarity.top_k(terms.where("id = 1"), tied, 2).orderBy("rank").collect()] == [4, 7]


def test_chains_stop_at_cycles_and_live_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "src string, dst string")
    start = spark.createDataFrame([("a",), ("x",), ("q",)], "node string")
    live = spark.createDataFrame([("c",)], "node string")
    assert {r.node: (r.chain_end, r.resolved) for r in resolve.chain_ends(start, edges, live).collect()} == {"a": ("c", True), "x": ("y", False), "q": ("q", False)}
    assert {r.node: (r.chain_end, r.resolved) for r in resolve.chain_ends(start, edges).collect()} == {"a": ("d", True), "x": ("y", False), "q": ("q", True)}


def test_rollup_keeps_every_live_term(spark):
    live = spark.createDataFrame([("T1",), ("T2",)], "target string")
    resolved = spark.createDataFrame([("a", "T1", "live"), ("b", "T1", "chain"), ("c", "T9", "delegated"), ("d", None, "unresolved")], "label string, target string, how string")
    usage = spark.createDataFrame([("a", 5, 1), ("b", 7, 1), ("c", 9, 1)], "label string, files long, datasets long")
    assert [tuple(r) for r in resolve.usage_rollup(live, resolved, usage).orderBy("target").collect()] == [("T1", 12, 2, "a|b"), ("T2", 0, 0, "")]


def test_summary_has_a_row_for_every_check(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "a", "x")], "k int, a string, b string")
    checks = {"one": validate.exactly_one(rows, "one", "k", "a", "b"), "if": validate.required_if(rows, "if", "k", F.col("k") == 1, "a"), "none": validate.duplicates(rows, "none", "k")}
    assert {r.rule: r.n for r in validate.summary(checks).collect()} == {"one": 1, "if": 1, "none": 0}


def test_liveness_needs_every_subject(spark):
    found = spark.createDataFrame([("f1", ["a", "b"]), ("f2", ["a", "gone"]), ("f3", ["old"]), ("f4", [])], "id string, subjects array<string>")
    aliases = spark.createDataFrame([("old", "a")], "node string, chain_end string")
    live = spark.createDataFrame([("a",), ("b",)], "sid string")
    assert sorted(r.id for r in curation.living(found, aliases, live).collect()) == ["f1", "f3"]


def test_schema_lint(spark):
    slots = spark.createDataFrame([("s1", True, False, ["e"], "Z"), ("s2", False, False, None, "string"), ("s3", True, True, [], "E1")], "slot string, required boolean, identifier boolean, examples array<string>, range string")
    uses = spark.createDataFrame([("A", "s1"), ("B", "s1"), ("A", "s3")], "class string, slot string")
    enums = spark.createDataFrame([("E1", "class"), ("E2", "enum")], "enum string, module_kind string")
    classes = spark.createDataFrame([("A", 2, "x"), ("B", 4, None), ("Z", 3, "y")], "class string, layer int, alignment string")
    found = {(r.rule, r.subject) for r in curation.schema_lint(slots, uses, enums, classes).collect()}
    assert found == {
        ("required-policy", "s1"), ("slot-no-examples", "s2"), ("slot-no-examples", "s3"), ("unused-slot", "s2"), ("shared-slot", "s1"),
        ("unused-enum", "E2"), ("inline-enum", "E1"), ("class-no-alignment", "B"), ("layer-violation", "A"),
    }


def test_axioms_as_statements(spark):
    rows = spark.createDataFrame([(1, "v:1", "l", "exact", "SO:2"), (2, "v:1", "l", "exact", "SO:1"), (3, "v:1", "l", "exact", "SO:2"), (4, "v:2", "m", "broad", "SO:3")], "row_no int, subject string, label string, fit string, object string")
    lines = [r.value for r in project.turtle(project.axioms(rows), "http://o/", "").orderBy("subject").collect()]
    assert lines == ["v:1 rdfs:subClassOf [ a owl:Class ; owl:unionOf ( <http://o/SO_2> <http://o/SO_1> ) ] .", "v:2 rdfs:subClassOf <http://o/SO_3> ."]


def test_element_types(spark):
    terms = spark.createDataFrame([("a", "SO:1|SO:2", "exact"), ("b", "not_applicable", ""), ("c", "SO:9", "odd")], "term string, element_type string, fit string")
    checks = validate.element_type_checks(terms, spark.createDataFrame([("SO:1",), ("SO:2",)], "object string"))
    assert {r.rule: r.n for r in validate.summary(checks).collect()} == {"element-live": 1, "element-fit": 1}


def test_self_pairs_hold_no_table_in_one_task(spark, monkeypatch):
    import numpy as np

    from lexiloom.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK", 16)
    x = np.random.default_rng(4).normal(size=(150, 3))
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "id long, embedding array<double>")
    out = similarity.self_pairs(vectors, 0.9)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 6) >= 0.9
    assert sorted((r.id1, r.id2) for r in out.collect()) == [(i, j) for i in range(150) for j in range(i + 1, 150) if near[i, j]]


def test_pipe_lists_are_trimmed(spark):
    assert one(spark, text.pipe_list(F.col("a")), a=" SO:10 |SO:11|  | SO:2") == ["SO:10", "SO:11", "SO:2"]
    assert one(spark, text.same_set(text.pipe_list(F.col("a")), text.pipe_list(F.col("b"))), a="x|y|x", b="y | x")


def test_legacy_forms(spark):
    forms = lambda enum: one(spark, text.legacy_forms(F.col("a"), F.col("e"), "ab", "http://v/"), a="A/B (x~y) called peaks*", e=enum)
    assert forms("Data") == ["ab:A/B_(x~y)_called_peaks*", "http://v/A/B_(x~y)_called_peaks*", "http://v/Data#A/B%20%28x~y%29%20called%20peaks%2A"]
    assert forms("") == forms("Data")[:2]


def test_long_chains_and_rings(spark):
    n = 5000
    pairs = [(f"a{k:05}", f"a{k + 1:05}") for k in range(n)] + [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("t1", "t2"), ("t2", "r2"), ("s", "s")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    start = spark.createDataFrame([("a00000",), ("a02500",), ("r1",), ("t1",), ("s",), ("q",)], "node string")
    found = {r.node: (r.chain_end, r.steps, r.resolved) for r in resolve.chain_ends(start, edges).collect()}
    assert found == {"a00000": (f"a{n:05}", n, True), "a02500": (f"a{n:05}", n - 2500, True), "r1": ("r3", 2, False), "t1": ("r1", 4, False), "s": ("s", 0, False), "q": ("q", 0, True)}
    assert resolve.chain_ends(start, edges.limit(0)).where("resolved and steps = 0").count() == 6


def test_class_slots_of_diamonds_overrides_and_rings(spark):
    levels = 30  # two ways up at each level: a thousand million paths
    edges = [(f"c{k}{s}", f"c{k + 1}{p}", o) for k in range(levels) for s in "xy" for o, p in enumerate("xy")]
    slots = spark.createDataFrame([(f"c{levels}x", "top"), ("c0x", "own"), ("c5y", "own")], "class string, slot string")
    usage = spark.createDataFrame([("c5y", "own", "sharper"), ("c7x", "own", "unused")], "class string, slot string, override string")
    rows = spark.createDataFrame(edges, "class string, parent string, ord int")
    out = {(r["class"], r.slot): (r.inherited_from, r.distance, r.override) for r in project.class_slots(rows, slots, usage).collect()}
    assert out[("c0x", "own")] == (None, 0, None) and out[("c0y", "own")] == ("c5y", 5, "sharper") and out[("c0x", "top")] == (f"c{levels}x", levels, None)
    with pytest.raises(ValueError, match="its own ancestor"):
        project.class_slots(spark.createDataFrame([("a", "b", 0), ("b", "a", 0)], "class string, parent string, ord int"), slots)


def test_vectors_of_several_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [0.9, None])], "id long, embedding array<double>")
    found = similarity.top_k(rows, rows, 2, others=True).collect()
    assert {(r.query_id, r.target_id) for r in found if r["rank"] == 1} == {(1, 7), (2, 1), (4, 1), (7, 1)}
    assert [(r.id1, r.id2) for r in similarity.self_pairs(rows, 0.99).orderBy("id1", "id2").collect()] == [(1, 2), (1, 7), (2, 7)]


def test_scores_rank_unrounded(spark):
    targets = spark.createDataFrame([(1, [1.0, 1e-4]), (2, [1.0, 1e-5])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "id long, embedding array<double>")
    assert similarity.top_k(asked, targets, 1).first().target_id == 2


def test_numbers_in_order(spark):
    from lexiloom.session import in_order

    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit(1).alias("at")).repartition(7)
    assert [(r.k, r.number) for r in in_order(rows, "number", 21, "k").orderBy("number").collect()] == [(k, 21 + k) for k in range(1000)]
    assert in_order(rows.limit(0), "number", 1, "k").count() == 0


def test_written_tables_can_be_released(spark):
    import os

    from lexiloom.session import durable, release

    path = durable(spark.range(3).toDF("x"), "t").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    release(spark)
    assert not os.path.exists(path)


def test_reasons_and_reviews(spark):
    found = spark.createDataFrame([("a", "terse-description", "it is 12 chars"), ("a", "mapping-suggestion", "m"), ("b", "no-mapping-at-all", ""), ("b", "unmapped-high-usage", "has 12345 files"), ("c", "terse-description", "?"), ("d", "layer-violation", "kept")], "subject string, rule string, message string")
    said = {(r.subject, r.rule): r.reason for r in browse.reasons(found).collect()}
    assert said == {
        ("a", "terse-description"): "Definition is very short (12 characters).", ("b", "unmapped-high-usage"): "Used by 12,345 files, but not linked to any outside ontology.",
        ("c", "terse-description"): "Definition is very short.", ("d", "layer-violation"): "kept",
    }
    queue = spark.createDataFrame([("a", "term"), ("e", "enum"), ("f", "slot"), ("g", "thing")], "subject string, kind string")
    assert {tuple(r) for r in browse.review_items(queue, found).collect()} == {("a", "vocabulary", "definitions"), ("a", "vocabulary", "links"), ("e", "vocabulary", "signoff"), ("f", "schema", "signoff")}


def test_promotion_and_lookup(spark):
    terms = spark.createDataFrame([("a", "draft"), ("b", "draft")], "subject string, status string")
    assert {tuple(r) for r in curation.promoted(terms, spark.createDataFrame([("b",)], "subject string"), "approved").collect()} == {("a", "draft"), ("b", "approved")}
    index = lexical.index(spark.createDataFrame(TERMS, SCHEMA))
    assert index.where(lexical.is_known("Copy-number Variation")).first().term_id == "SO:0001019"
    forms = validate.element_forms(spark.createDataFrame([("a", "SO:1| bad |x:"), ("b", "not_applicable")], "term string, element_type string"))
    assert sorted(r.message for r in forms.collect()) == ["bad", "x:"]


def test_nearest_of_many_tiles(spark, monkeypatch):
    """Groups of several blocks, parts of several lengths, ties, null parts: the nearest by brute force, from many tiles side by side."""
    import numpy as np

    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "GROUPS", 3)
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(-1, 2, 6).astype(float).tolist(), ("a", "b", None)[k % 5 % 3]) for k in range(300)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>, part string")
    x = np.array([r[1] for r in rows])
    norms = np.sqrt((x * x).sum(axis=1))
    s = np.round((x / np.where(norms > 0, norms, 1)[:, None]) @ (x / np.where(norms > 0, norms, 1)[:, None]).T, 12)
    for by_part in (False, True):
        want = set()
        for q, _, _ in rows:
            for part in (("a", "b", None) if by_part else ("*",)):
                best = sorted((-s[q, i], i) for i, _, p in rows if i != q and part in ("*", p) and s[q, i] >= 0.5)[:4]
                want |= {(q, i, n + 1) for n, (_, i) in enumerate(best)}
        found = similarity.top_k(frame, frame, 4, 0.5, by_part=by_part, others=True)
        assert {(r.query_id, r.target_id, r["rank"]) for r in found.collect()} == want
    pairs = similarity.self_pairs(frame.drop("part"), 0.5)
    assert sorted((r.id1, r.id2) for r in pairs.collect()) == [(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.5]
    blocks, _, n = similarity._grouped(similarity._dealt(frame.withColumn("part", F.lit(""))), "column")
    assert n >= 3 and blocks.groupBy("column").count().agg(F.max("count")).first()[0] <= similarity.GROUP
    assert met_partitions(similarity.top_k(frame, frame, 4)) >= n * n


def met_partitions(found):
    """Partitions of the exchange that tiles come by."""
    import re

    return max(map(int, re.findall(r"hashpartitioning\(dim#\d+, row#\d+L?, column#\d+L?, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())), default=0)


def test_suffixes_normalize_a_text_once(spark):
    from lexiloom.functions import text

    frame = spark.createDataFrame([("Old blue peaks",), (None,), ("-",)], "c string").select(text.token_suffixes(F.col("c")).alias("s"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4 and plan.count("split(") == 1
    first, none, empty = (r.s for r in frame.collect())
    assert [(f.phrase, f.start) for f in first] == [(p, k) for k, w in enumerate(("old blue ", "blue ", "")) for p in (f"{w}peaks", f"{w}peak")]
    assert none is None and empty == []


def test_a_class_that_has_one_parent_has_one_way_up(spark):
    edges = spark.createDataFrame([(f"C{k}", f"C{k // 2}", 0) for k in range(2, 40)], "class string, parent string, ord int")
    up = project.ancestors(edges, edges.select("class").union(edges.select("parent")))
    want = {(f"C{k}", f"C{k >> d}", d) for k in range(1, 40) for d in range(k.bit_length())}
    assert {(r["class"], r.ancestor, r.distance) for r in up.collect()} == want
    assert "Aggregate" not in up._jdf.queryExecution().optimizedPlan().toString()  # rounds are not gathered again and again
