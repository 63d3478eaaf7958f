"""Versions that switch at once, incremental rebuilds, ordered edits, facet values, collation and the overview's levels."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.operators import curation, project, reports
from lexiloom.sources import publish


def docs(spark, *rows):
    return spark.createDataFrame(rows, "name string, body string, more int")


def test_versions_in_the_order_of_numbers(spark, tmp_path):
    root = str(tmp_path / "registry")
    assert publish.version_list(spark, root).count() == 0
    for version in ("0.10.0", "0.9.1", "1.0.0-rc1", "1.0.0", "0.9.0"):
        publish.publish(docs(spark, ("a", f"in {version}", 1), ("b", None, 1)), root, version)
    rows = publish.version_list(spark, root).orderBy("place").collect()
    assert [(r.version, r.status) for r in rows] == [("0.9.0", "current"), ("0.9.1", "superseded"), ("0.10.0", "superseded"), ("1.0.0-rc1", "superseded"), ("1.0.0", "superseded")]
    assert publish.published(spark, root).where("name = 'a'").first().body == "in 0.9.0"
    assert publish.published(spark, root, "0.10.0").where("name = 'a'").first().body == "in 0.10.0"
    made = publish.published(spark, root, "0.9.1", "manifest").where("name = 'a'").first()
    assert made["bytes"] == 8 and len(made.sha256) == 64


def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "registry")
    publish.publish(docs(spark, ("a", "first", 1)), root, "1")
    broken = docs(spark, ("a", "second", 1)).withColumn("body", F.raise_error(F.lit("no body")).cast("string"))
    with pytest.raises(Exception, match="no body"):
        publish.publish(broken, root, "1")
    with pytest.raises(Exception, match="no body"):
        publish.publish(broken, root, "2")
    with pytest.raises(ValueError, match="not the only one"):
        publish.publish(docs(spark, ("a", "x", 1), ("a", "y", 1)), root, "2")
    with pytest.raises(ValueError, match="no version"):
        publish.publish(docs(spark, ("a", "x", 1)), root, "../2")
    assert publish.published(spark, root).first().body == "first" and publish.version_list(spark, root).count() == 1
    publish.publish(docs(spark, ("a", "second", 1)), root, "1")
    assert publish.published(spark, root).first().body == "second"
    with pytest.raises(FileNotFoundError):
        publish.published(spark, root, "3")


def test_only_what_changed_is_rebuilt(spark, tmp_path):
    root, asked = str(tmp_path / "store"), []

    def build(todo):
        asked.append(sorted(r.part for r in todo.collect()))
        return todo.select("part", F.concat(F.lit("from "), "hash").alias("made"))

    def refresh(force=False, **hashes):
        plan = publish.refresh(spark, root, spark.createDataFrame(list(hashes.items()), "part string, hash string"), build, force)
        return {r.part: r.reason for r in plan.collect()}

    assert refresh(a="1", b="1", c="1") == {"a": "missing", "b": "missing", "c": "missing"}
    before = sorted(os.listdir(root))
    files = sorted(os.listdir(f"{root}/data"))
    assert refresh(a="1", b="1", c="1") == {"a": None, "b": None, "c": None} and sorted(os.listdir(root)) == before and sorted(os.listdir(f"{root}/data")) == files
    assert refresh(a="1", b="2", d="1") == {"a": None, "b": "hash changed (1 -> 2)", "c": "removed", "d": "missing"}
    assert asked == [["a", "b", "c"], ["b", "d"]]
    assert {r.part: r.made for r in publish.current_rows(spark, root).collect()} == {"a": "from 1", "b": "from 2", "d": "from 1"}
    assert refresh(a="1", b="2", d="1", force=True) == {"a": "forced", "b": "forced", "d": "forced"} and asked[-1] == ["a", "b", "d"]

    def fails(todo):
        return todo.select("part", F.raise_error(F.lit("no model")).cast("string").alias("made"))

    with pytest.raises(Exception, match="no model"):
        publish.refresh(spark, root, spark.createDataFrame([("a", "9")], "part string, hash string"), fails)
    assert publish.current_rows(spark, root).count() == 3 and refresh(a="1", b="2", d="1") == {"a": None, "b": None, "d": None}
    with pytest.raises(ValueError, match="not the only one"):
        refresh_twice = spark.createDataFrame([("a", "1"), ("a", "2")], "part string, hash string")
        publish.refresh(spark, root, refresh_twice, build)


def least_moves(have, want):
    """By trying all: how many of the common objects must move."""
    common = [v for v in have if v in want]
    for n in range(len(common) + 1):
        for moved in itertools.combinations(common, n):
            if [v for v in have if v in common and v not in moved] == [v for v in want if v in common and v not in moved]:
                return n
    return None


def test_edits_are_the_fewest(spark):
    random.seed(5)
    cases = [(None, ["a"]), (["a"], None), ([], []), (["a", "b"], ["a", "b"]), (["b", "a"], ["a", "b"]), (["a", "a", "b"], ["a", "b", "a"])]
    cases += [(random.sample("abcdefg", random.randint(0, 6)), random.sample("abcdefg", random.randint(0, 6))) for _ in range(60)]
    rows = spark.createDataFrame([(k, "s", h, w) for k, (h, w) in enumerate(cases)], "subject int, slot string, have array<string>, want array<string>")
    found = {r.subject: r for r in project.list_edits(rows).collect()}
    for k, (have, want) in enumerate(cases):
        have, want = have or [], want or []
        if have == want:
            assert k not in found
            continue
        edits = found[k].edits
        of = lambda op: [e for e in edits if e.op == op]  # noqa: B023, E731
        assert found[k].same_set == (set(have) == set(want))
        gone, moved = {e["at"] for e in of("delete")}, {e["at"]: e["to"] for e in of("move")}
        out = {e["to"]: e["object"] for e in of("insert")} | {to: have[at] for at, to in moved.items()}
        stays = iter([v for at, v in enumerate(have) if at not in gone and at not in moved])
        assert [out[k] if k in out else next(stays) for k in range(len(want))] == want, (have, want)
        if len(set(have)) == len(have) and len(set(want)) == len(want):
            assert len(moved) == least_moves(have, want) and len(gone) == len(set(have) - set(want))


def test_facet_values_are_found_without_a_nested_loop(spark):
    values = spark.range(30_000).select(F.concat(F.lit("Value "), F.col("id").cast("string"), F.lit("-x")).alias("value"))
    terms = spark.createDataFrame([(1, "A value 17 X, male"), (2, "value 17"), (3, "VALUE 29999 x of value 3-x"), (4, "kept value 5 x"), (5, None)], "subject int, label string")
    found = curation.residual_compounds(terms, ("male", "--"), spark.createDataFrame([(4,)], "subject int"), values)
    assert sorted((r.subject, r.words) for r in found.collect()) == [(1, "Value 17-x|male"), (3, "Value 29999-x|Value 3-x")]
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert curation.residual_compounds(terms, (), spark.createDataFrame([(4,)], "subject int"), values.limit(0)).count() == 0


def test_names_are_sorted_as_readers_expect(spark):
    names = spark.createDataFrame([("Zebra",), ("äpfel",), ("apfel",), ("Apfel",), ("zebra",), ("Ärger",)], "name string")
    assert [r.name for r in names.orderBy(text.locale_key(F.col("name"))).collect()] == ["apfel", "Apfel", "äpfel", "Ärger", "zebra", "Zebra"]


def test_too_many_prompts_are_told(spark, monkeypatch):
    monkeypatch.setattr(curation, "MOST_PROMPTS", 1)
    prompts = spark.createDataFrame([("a", None, None, None), ("b", None, None, None)], "prompt string, kinds array<string>, layers array<int>, signals array<string>")
    subjects = spark.createDataFrame([(1, "term", 1, [])], "subject int, kind string, layer int, signals array<string>")
    with pytest.raises(ValueError, match="2 prompts"):
        curation.matching_prompts(subjects, prompts)


def test_overview_levels(spark):
    row = "struct<predicate: string, object: string, modifier: string>"
    rows = [
        ("term", "A", 1, "t1", False, [("m", "B:1", None), ("r", "B:2", "Not")]), ("term", "A", 1, "t2", False, [("r", "X:1", None)]), ("term", "A", 1, "t3", True, [("m", "B:1", None)]), ("class", None, 2, None, False, None),
    ]
    subjects = spark.createDataFrame(rows, f"kind string, enum string, layer int, term_id string, retired boolean, mappings array<{row}>")
    found = {(r.level, r.kind, r.enum, r.layer, r.predicate): r for r in reports.overview(subjects, {"m": "member", "r": "related"}, "m", "r", "B:", "none").collect()}
    assert set(found) == {("all", None, None, None, None), ("kind", "term", None, None, None), ("kind", "class", None, None, None), ("enum", None, "A", None, None), ("layer", "term", None, 1, None), ("layer", "class", None, 2, None), ("predicate", None, None, None, "member"), ("predicate", None, None, None, "related")}
    a = found["enum", None, "A", None, None]
    assert (a.n, a.mapped, a.annotated, a.with_class, a.retired, a.first_id, a.last_id, a.rows) == (2, 2, 1, 1, 1, "t1", "t2", 2)
    assert found["predicate", None, None, None, "member"].n == 1 and found["all", None, None, None, None].n == 3


def test_reasons_in_full(spark):
    from lexiloom.operators import browse

    rows = [
        (1, "unreviewed-mapping", "'term' skos:exactMatch e:1 has no mapping", None, 'Has a link nobody has checked: skos:exactMatch e:1.'), (2, "unreviewed-mapping", "odd", None, "Has a link nobody has checked: odd."),
        (3, "todo-marker", "has a comment TODO: say more", None, "Has a TODO note: TODO: say more"), (4, "similar-terms", "similarity 0.925 to x", "peaks", 'Reads almost the same as "peaks" (92% similar).'),
        (5, "similar-terms", "no number", None, 'Reads almost the same as "".'), (6, "residual-compound", "'x' contains facet word(s) a, b and has no keep_atomic", None, 'Contains the facet word "a, b": it might be two ideas glued together.'),
        (7, "inline-enum", "is defined inside class module file", None, 'Defined inside the class module "file" rather than in a vocabulary module.'), (8, "mapping-target-is-doc-link", "value http://x is a documentation page", None, "Points to a web page (http://x), not to a term."),
        (9, "required-policy", "", None, "Marked required, but it is not an identifier. Every required field is extra work for adopters."), (10, "unmapped-high-usage", "has 12345 files", None, "Used by 12,345 files, but not linked to any outside ontology."),
        (11, "another-rule", "its own words", None, "its own words"),
    ]
    found = spark.createDataFrame([r[:4] for r in rows], "subject int, rule string, message string, other string")
    said = {r.subject: r.reason for r in browse.reasons(found).collect()}
    assert said == {r[0]: r[4] for r in rows}


def test_one_store_asked_opens_one(spark, tmp_path):
    from lexiloom.sources import sinks

    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    for name in ("own", "so", "edam"):
        sinks.write_embeddings(vectors, str(tmp_path / name), {"model_name": "m" if name != "edam" else "other", "source": name})
    found = sinks.read_stores(spark, str(tmp_path), "own", "m", only=("so",)).collect()  # the other model's store is not looked at
    assert [(r.ontology, r.provenance["source"], r.id) for r in found] == [("so", "so", 1)]
    assert {r.ontology for r in sinks.read_stores(spark, str(tmp_path), "own").collect()} == {"so", "edam"}
    with pytest.raises(FileNotFoundError, match="zfa"):
        sinks.read_stores(spark, str(tmp_path), "own", only=("so", "zfa"))


def test_documents_of_several_kinds(spark, tmp_path):
    from lexiloom.sources import sinks

    rows = spark.createDataFrame([(k, f"n{k}", [k, None]) for k in range(5)], "id long, name string, list array<int>")
    made = [sinks.document("a", rows, "id", "name", "list"), sinks.document("b", rows.limit(2), "name", "id")]
    sinks.write_documents(made, str(tmp_path / "out"))
    found = {(r.kind, r.key): r.body for r in sinks.read_documents(spark, str(tmp_path / "out")).collect()}
    assert len(found) == 7 and found["a", "3"] == '{"list":[3,null],"name":"n3"}' and found["b", "n0"] == '{"id":0}'
    with pytest.raises(ValueError, match="more than one"):
        sinks.write_documents([made[0], made[0]], str(tmp_path / "again"))
    assert not (tmp_path / "again").exists()
