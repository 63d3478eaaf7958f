"""Findings, lint, subject states, queue and rollups of a curated vocabulary, and edits as functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import blank, finding_id, squeeze, word_tokens
from lexiloom.session import durable, in_order

# Weights of the queue and points of severities.
WEIGHTS = {"findings": 0.5, "impact": 2.0, "adoption": 0.5, "required": 0.5, "port": 3.0, "upstream": 2.0, "stale": 3.0, "machine": 1.0}
SEVERITY_POINTS = {"error": 3, "warn": 2, "info": 1}
RULE_SEVERITY = {"similar-terms": "warn", "coverage-gap": "info", "mapping-suggestion": "info"}


def severity_points(severity: Column) -> Column:
    out = F.lit(0)
    for name, points in SEVERITY_POINTS.items():
        out = F.when(severity == name, points).otherwise(out)
    return out


def findings(pairs: DataFrame, gaps: DataFrame, suggestions: DataFrame) -> DataFrame:
    """id, rule, severity, subject1, subject2, message from similar pairs, gaps and suggestions.

    pairs: (id1, id2, similarity); gaps: (id, max_similarity); suggestions: (id, object, similarity). Ids are strings.
    """
    severity = lambda rule: F.lit(RULE_SEVERITY[rule]).alias("severity")
    none = F.lit(None).cast("string").alias("subject2")
    a = pairs.select(
        finding_id("sim", F.col("id1"), F.col("id2"), ordered=False).alias("id"), F.lit("similar-terms").alias("rule"), severity("similar-terms"), F.col("id1").alias("subject1"), F.col("id2").alias("subject2"),
        F.format_string("similar to %s (%.3f)", F.col("id2"), F.col("similarity")).alias("message"),
    )
    b = gaps.select(
        finding_id("gap", F.col("id")).alias("id"), F.lit("coverage-gap").alias("rule"), severity("coverage-gap"), F.col("id").alias("subject1"), none,
        F.format_string("best match %.3f", F.col("max_similarity")).alias("message"),
    )
    c = suggestions.select(
        finding_id("map", F.col("id"), F.col("object")).alias("id"), F.lit("mapping-suggestion").alias("rule"), severity("mapping-suggestion"), F.col("id").alias("subject1"), none,
        F.format_string("maps to %s (%.3f)", F.col("object"), F.col("similarity")).alias("message"),
    )
    return a.unionByName(b).unionByName(c)


def fresh_findings(found: DataFrame, reports: DataFrame, fingerprint: str, keep_stale: bool = False) -> DataFrame:
    """Findings of reports (source, fingerprint); a stale report's go, or stay marked as stale."""
    state = reports.select("source", (F.col("fingerprint") != fingerprint).alias("stale"))
    out = found.join(state, "source")
    return out if keep_stale else out.where("not stale")


def living(found: DataFrame, aliases: DataFrame, live: DataFrame) -> DataFrame:
    """Findings (id, subjects) all of whose subjects are live, by themselves or through aliases (node, chain_end).

    A finding without subjects does not live.
    """
    each = found.select("id", F.explode("subjects").alias("node"))
    each = each.join(aliases.select("node", "chain_end"), "node", "left").withColumn("sid", F.coalesce("chain_end", "node"))
    each = each.join(live.select(F.col("sid"), F.lit(True).alias("_live")), "sid", "left")
    ok = each.groupBy("id").agg(F.bool_and(F.coalesce("_live", F.lit(False))).alias("ok")).where("ok")
    return found.join(ok.select("id"), "id", "left_semi")


def by_subject(found: DataFrame) -> DataFrame:
    """subject, findings, points: open findings (id, subjects, severity) of each subject."""
    each = found.select("id", "severity", F.explode(F.array_distinct("subjects")).alias("subject"))
    return each.groupBy("subject").agg(F.count("*").alias("findings"), F.sum(severity_points(F.col("severity"))).alias("points"))


def decisions_of(subjects: DataFrame, decisions: DataFrame) -> DataFrame:
    """subject, id, role: decisions (id, subject, also_affects, created) that name a subject, once each, by their first role."""
    role = lambda name, column, n: decisions.select("id", F.explode(column).alias("subject"), F.struct(F.lit(n).alias("n"), F.lit(name).alias("role")).alias("r"))
    named = role("subject", F.array("subject"), 0).unionByName(role("also", "also_affects", 1)).unionByName(role("created", "created", 2))
    first = named.groupBy("subject", "id").agg(F.min("r").alias("r")).select("subject", "id", "r.role")
    return first.join(subjects.select("subject").distinct(), "subject", "left_semi")


def undecided(found: DataFrame, decisions: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Findings (id, subjects) that no decision (id, subject, status, evidence) cites and no subject of which has one.

    With subjects (subject, retired), a subject that is missing or retired counts as decided too.
    """
    active = decisions.where("status <> 'withdrawn'")
    cited = active.select(F.explode("evidence").alias("id"))
    each = found.select("id", F.explode("subjects").alias("subject"))
    about = each.join(active.select("subject"), "subject", "left_semi").select("id")
    if subjects is not None:
        about = about.union(each.join(subjects.where("not retired").select("subject"), "subject", "left_anti").select("id"))
    return found.join(cited.union(about).distinct(), "id", "left_anti")


def open_by_rule(found: DataFrame, subjects: DataFrame) -> DataFrame:
    """source, rule, n: findings (id, source, rule, subjects) that a subject (subject, retired) which is not retired has."""
    live = subjects.where("not retired").select("subject")
    ids = found.select("id", F.explode("subjects").alias("subject")).join(live, "subject", "left_semi").select("id").distinct()
    return found.join(ids, "id", "left_semi").groupBy("source", "rule").agg(F.count_distinct("id").alias("n"))


def by_rule(found: DataFrame, kinds: DataFrame) -> DataFrame:
    """place, rule, severity, n, kinds: findings (id, rule, severity, subjects) of each rule, by severity and then name.

    kinds: (subject, kind); the kinds of a rule's subjects are sorted and |-joined. A rule's severity is its worst one.
    """
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).when(F.col("severity") == "info", 2).otherwise(3)
    counts = found.groupBy("rule").agg(F.min_by("severity", order).alias("severity"), F.min(order).alias("_order"), F.count("*").alias("n"))
    seen = found.select("rule", F.explode("subjects").alias("subject")).distinct().join(kinds, "subject").groupBy("rule").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))
    place = F.row_number().over(Window.orderBy("_order", "rule"))  # a row for each rule
    return counts.join(seen, "rule", "left").select(place.alias("place"), "rule", "severity", "n", F.coalesce("kinds", F.lit("")).alias("kinds"))


def containers(subjects: DataFrame) -> DataFrame:
    """subjects (sid, kind, layer, container, owner_class) with `key`, the container that a rollup counts them in, and `home`.

    A term and a usage count in their container, an enum and a class in themselves, a class's own slot in the class; the
    rest counts by layer. home is the subject whose layer the container has, or null for those of a layer.
    """
    kind, layer = F.col("kind"), F.coalesce(F.col("layer"), F.lit(0))
    home = (
        F.when(kind.isin("term", "usage") & F.col("container").isNotNull(), F.col("container"))
        .when(kind.isin("enum", "class"), F.col("sid"))
        .when((kind == "slot") & F.col("owner_class").isNotNull(), F.concat(F.lit("class:"), "owner_class"))
    )
    group = F.when(kind == "slot", "shared-slots").when(kind == "subset", "subsets").when(kind == "module", "modules").otherwise("other")
    return subjects.withColumn("home", home).withColumn("key", F.coalesce("home", F.concat(group, F.lit(":"), layer.cast("string"))))


def container_rollup(subjects: DataFrame, states: tuple[str, ...] = ("applied", "settled", "deferred", "open", "stale", "unreviewed")) -> DataFrame:
    """layer, key, a count for each state, total, percent: subjects (sid, kind, layer, container, owner_class, state, retired).

    A null key is a layer's subtotal, a null layer the total. A container has its own layer, or its first member's where
    it is no subject. Retired subjects do not count.
    """
    rows = containers(subjects.where("not retired"))
    homes = subjects.where("not retired").select(F.col("sid").alias("home"), F.col("layer").alias("home_layer"))
    rows = rows.join(homes, "home", "left").withColumn("own", F.coalesce("layer", F.lit(0)))
    layers = rows.groupBy("key").agg(F.coalesce(F.max("home_layer"), F.min("own")).alias("at"))
    rows = rows.join(layers, "key").select(F.col("at").alias("layer"), "key", "state")
    settled = F.count_if(F.col("state").isin("applied", "settled"))
    counts = [F.count_if(F.col("state") == s).alias(s) for s in states]
    out = rows.rollup("layer", "key").agg(*counts, F.count("*").alias("total"), (F.round(1000 * settled / F.count("*")) / 10).alias("percent"))
    return out


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Each subject's last decision (id, subject, status) that is not withdrawn."""
    number = F.row_number().over(Window.partitionBy("subject").orderBy(F.col("id").desc()))
    return decisions.where("status <> 'withdrawn'").withColumn("_n", number).where("_n = 1").drop("_n")


def states(subjects: DataFrame, decisions: DataFrame, open_findings: DataFrame) -> DataFrame:
    """subject, layer, state. Our specification: the latest decision decides, and findings open what has none.

    subjects: (subject, layer, hash); decisions: (id, subject, status, terminal, hash); open_findings: (subject).
    """
    last = latest_decisions(decisions).select("subject", "status", "terminal", F.col("hash").alias("_hash"))
    has = open_findings.select("subject").distinct().withColumn("_open", F.lit(True))
    out = subjects.join(last, "subject", "left").join(has, "subject", "left")
    state = (
        F.when(F.col("status").isNull() & F.col("_open"), "open")
        .when(F.col("status").isNull(), "unreviewed")
        .when(~F.col("terminal"), "deferred")
        .when(F.col("_hash") != F.col("hash"), "stale")
        .when(F.col("status") == "applied", "applied")
        .otherwise("settled")
    )
    return out.select("subject", "layer", state.alias("state"))


def state_rollup(rows: DataFrame, by: str, state: str) -> DataFrame:
    """by, state, n with subtotals: null by or state stands for all."""
    return rows.rollup(by, state).agg(F.count("*").alias("n"))


def percent_settled(rows: DataFrame, by: str) -> DataFrame:
    settled = F.count_if(F.col("state").isin("applied", "settled"))
    return rows.groupBy(by).agg(F.count("*").alias("total"), settled.alias("settled"), (F.round(1000 * settled / F.count("*")) / 10).alias("percent"))


def queue(subjects: DataFrame) -> DataFrame:
    """score of subjects (subject, points, impact, adoption, required, port, upstream, stale, machine), and its place."""
    flag = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    score = F.lit(WEIGHTS["findings"]) * F.least(F.lit(10.0), flag("points"))
    for name in ("impact", "adoption", "required", "port", "upstream", "stale", "machine"):
        score = score + F.lit(WEIGHTS[name]) * flag(name)
    return subjects.withColumn("score", F.round(score, 6))


def orphan_values(values: DataFrame, used: DataFrame) -> DataFrame:
    """Facet values (axis, value) that no decomposition row or example (axis, value) uses."""
    return values.join(used.select("axis", "value").distinct(), ["axis", "value"], "left_anti")


def residual_compounds(terms: DataFrame, words: tuple[str, ...], kept: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """terms (subject, label) whose label holds a facet word or a facet value's label, and that no decision (subject) keeps whole.

    values: (value), of any number. Words and values stand on word boundaries, case aside; `words` lists what was found,
    sorted and joined by |. Labels and values meet by an equality join on runs of words: a label gives its runs of the
    lengths that values have, so a label of m words costs m rows for each length.
    """
    fixed = terms.sparkSession.createDataFrame([(w,) for w in words], "value string")
    wanted = fixed if values is None else fixed.unionByName(values.select("value"))
    wanted = durable(wanted.distinct().withColumn("run", word_tokens(F.col("value"))).where(F.size("run") > 0), "facets")
    lengths = sorted(r["n"] for r in wanted.select(F.size("run").alias("n")).distinct().collect())  # as many as lengths of labels
    if not lengths:
        return terms.limit(0).withColumn("words", F.lit(""))
    held = terms.select("subject", "label", word_tokens(F.col("label")).alias("of"))
    starts = lambda n: F.when(F.size("of") >= n, F.sequence(F.lit(1), F.size("of") - (n - 1))).otherwise(F.array().cast("array<int>"))
    cut = lambda n: F.transform(starts(n), lambda at: F.slice("of", at, F.lit(n)))
    runs = held.select("subject", "label", F.explode(F.array_distinct(F.flatten(F.array(*(cut(n) for n in lengths))))).alias("run"))
    found = runs.join(wanted, "run").groupBy("subject", "label").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("words"))
    return found.join(kept.select("subject"), "subject", "left_anti")


# Lint rules with their severity and suggested verdict, and the numbers that they use.
LINT = {
    "required-policy": ("warn", "set_cardinality"), "mapping-target-is-doc-link": ("warn", "reject_mapping"), "todo-marker": ("warn", "edit_description"),
    "enum-value-no-description": ("warn", "edit_description"), "unreviewed-mapping": ("warn", "adopt_mapping"), "layer-violation": ("error", "retype_slot"),
    "unused-slot": ("warn", "delete_slot"), "unused-enum": ("warn", "delete_enum"), "shared-slot": ("info", "keep"), "slot-no-examples": ("info", "set_examples"),
    "inline-enum": ("info", "move_enum"), "class-no-alignment": ("info", "adopt_mapping"), "residual-compound": ("warn", "facet"), "no-mapping-at-all": ("info", "adopt_mapping"),
    "terse-description": ("warn", "edit_description"), "duplicate-description": ("warn", "edit_description"), "singleton-subset": ("info", "merge_subset"),
    "oversized-subset": ("info", "keep"), "orphan-facet-value": ("warn", "delete"), "zero-usage-term": ("info", "keep"), "unmapped-high-usage": ("warn", "adopt_mapping"),
    "duplicate-paragraph": ("info", "edit_description"),
}
TERSE, OVERSIZED, HIGH_USAGE = 40, 25, 100
TODO = (r"\bTODO\b", r"\bplaceholder\b", r"\bfor now\b", r"\bplanned\b.*\bdeferred\b")
FACET_WORDS = (
    "strand", "stranded", "unique", "multimapping", "normalized", "normalised", "filtered", "unfiltered", "thresholded", "predicted", "observed",
    "pseudoreplicated", "replicated", "conservative", "optimal", "haplotype", "maternal", "paternal", "male", "female",
)


def lint_row(rows: DataFrame, rule: str, subject: str) -> DataFrame:
    severity, verdict = LINT[rule]
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject"), F.lit(verdict).alias("suggested_verdict"))


def description_lint(terms: DataFrame) -> DataFrame:
    """Rules over terms (subject, description): none, terse, todo marker, the same text or paragraph elsewhere.

    Descriptions are read once. Texts and paragraphs go on as 128-bit digests; what several terms share is found by
    counting digests, so that no text moves.
    """
    text = blank(F.col("description"))
    todo = F.lit(False)
    for pattern in TODO:
        todo = todo | text.rlike(f"(?i){pattern}")
    none = F.lit(None).cast("string")
    hit = lambda rule, bad, key=none: F.when(bad, F.struct(F.lit(rule).alias("rule"), key.alias("key")))
    paragraphs = F.array_distinct(F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: squeeze(F.lower(p))), lambda p: p != ""))
    hits = F.array_compact(
        F.array(
            hit("enum-value-no-description", text == ""), hit("terse-description", (text != "") & (F.length(text) < TERSE)), hit("todo-marker", todo),
            hit("duplicate-description", text != "", F.md5(squeeze(F.lower(text)))),
        )
    )
    each = F.transform(paragraphs, lambda p: F.struct(F.lit("duplicate-paragraph").alias("rule"), F.md5(p).alias("key")))
    found = durable(terms.select("subject", F.explode(F.concat(hits, each)).alias("h")).select("subject", "h.rule", "h.key"), "lint")
    keyed = found.where("key is not null")
    texts = keyed.where("rule = 'duplicate-description'").groupBy("rule", "key").agg(F.count("*").alias("n"))
    parts = keyed.where("rule = 'duplicate-paragraph'").groupBy("rule", "key").agg(F.count_distinct("subject").alias("n"))
    shared = durable(texts.unionByName(parts).where("n > 1").select("rule", "key"), "shared")
    copies = keyed.join(shared, ["rule", "key"], "left_semi")
    rules = {r: found.where((F.col("rule") == r) & F.col("key").isNull()) for r in ("enum-value-no-description", "terse-description", "todo-marker")}
    rules["duplicate-description"] = copies.where("rule = 'duplicate-description'")
    rules["duplicate-paragraph"] = copies.where("rule = 'duplicate-paragraph'").select("subject").distinct()
    return _all(rules, "subject")


def _all(rules: dict[str, DataFrame], subject: str) -> DataFrame:
    parts = [lint_row(rows, rule, subject) for rule, rows in rules.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def usage_lint(terms: DataFrame, usage: DataFrame, mappings: DataFrame) -> DataFrame:
    """Rules over terms (subject), usage (subject, files), mappings (subject, modifier, object, decided)."""
    used = terms.join(usage.select("subject", "files"), "subject", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    positive = mappings.where(blank(F.col("modifier")) != "Not")
    rules = {
        "zero-usage-term": used.where("files = 0"),
        "unmapped-high-usage": used.where(F.col("files") >= HIGH_USAGE).join(positive.select("subject"), "subject", "left_anti"),
        "no-mapping-at-all": terms.join(mappings.select("subject"), "subject", "left_anti"),
        "unreviewed-mapping": mappings.where(~F.col("decided")).select("subject").distinct(),
        "mapping-target-is-doc-link": mappings.where(F.col("object").rlike("^https?://")).select("subject").distinct(),
    }
    return _all(rules, "subject")


def subset_lint(members: DataFrame) -> DataFrame:
    """Rules over members (subset, subject)."""
    sizes = members.groupBy("subset").agg(F.count_distinct("subject").alias("_n"))
    return _all({"singleton-subset": sizes.where("_n = 1"), "oversized-subset": sizes.where(F.col("_n") > OVERSIZED)}, "subset")


def schema_lint(slots: DataFrame, uses: DataFrame, enums: DataFrame, classes: DataFrame) -> DataFrame:
    """Rules over slots (slot, required, identifier, examples, range), uses (class, slot), enums (enum, module_kind)
    and classes (class, layer, alignment)."""
    listed = uses.groupBy("slot").agg(F.count_distinct("class").alias("_n"))
    layered = uses.join(slots.select("slot", "range"), "slot").join(classes.select("class", "layer"), "class")
    ranged = classes.select(F.col("class").alias("range"), F.col("layer").alias("range_layer"))
    rules = {
        "required-policy": slots.where("required and not identifier").select(F.col("slot").alias("s")),
        "slot-no-examples": slots.where(F.coalesce(F.size("examples"), F.lit(0)) < 1).select(F.col("slot").alias("s")),
        "unused-slot": slots.join(uses, "slot", "left_anti").select(F.col("slot").alias("s")),
        "shared-slot": listed.where("_n > 1").select(F.col("slot").alias("s")),
        "unused-enum": enums.join(slots.select(F.col("range").alias("enum")), "enum", "left_anti").select(F.col("enum").alias("s")),
        "inline-enum": enums.where("module_kind = 'class'").select(F.col("enum").alias("s")),
        "class-no-alignment": classes.where(blank(F.col("alignment")) == "").select(F.col("class").alias("s")),
        "layer-violation": layered.join(ranged, "range").where("layer < range_layer").select(F.col("class").alias("s")).distinct(),
    }
    return _all(rules, "s")


def group_by_rationale(decisions: DataFrame) -> DataFrame:
    """reason, first_ord, terms, enums, ids: decisions (ord, id, label, enum, rationale, status) by their reason's words."""
    rows = decisions.where("status <> 'withdrawn'").withColumn("reason", squeeze(F.col("rationale")))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda s: s[c].cast("string")), ",")
    return rows.groupBy("reason").agg(F.min("ord").alias("first_ord"), in_order("label").alias("terms"), F.array_join(F.array_sort(F.collect_set("enum")), ",").alias("enums"), in_order("id").alias("ids"))


def numbered(decisions: DataFrame, start: int = 21) -> DataFrame:
    """Applied decisions that write something and are no seeds, numbered by (applied_on, id)."""
    return in_order(decisions.where("status = 'applied' and origin <> 'seed' and writes <> 'none'"), "number", start, "applied_on", "id")


#: Prompts that may be broadcast.
MOST_PROMPTS = 10_000


def matching_prompts(subjects: DataFrame, prompts: DataFrame) -> DataFrame:
    """subject, prompt: every prompt (prompt, kinds, layers, signals) all of whose given conditions a subject meets.

    subjects: (subject, kind, layer, signals: array of names that hold). A null condition is not given. Prompts are a
    list that people write: MOST_PROMPTS of them at most, which is checked, are broadcast and their conditions tested on
    each subject, so no subject moves.
    """
    asked = durable(prompts.select("prompt", "kinds", "layers", F.col("signals").alias("want")), "prompts")
    n = asked.count()
    if n > MOST_PROMPTS:
        raise ValueError(f"{n} prompts are more than the {MOST_PROMPTS} that each subject can be tested on")
    fits = lambda c, ok: F.col(c).isNull() | ok
    ok = fits("kinds", F.array_contains("kinds", F.col("kind"))) & fits("layers", F.array_contains("layers", F.col("layer"))) & fits("want", F.arrays_overlap("want", "have"))
    rows = subjects.withColumnRenamed("signals", "have")
    return rows.join(F.broadcast(asked), ok).select("subject", "prompt").distinct()


def apply_facet(terms: DataFrame, decompositions: DataFrame, ledger: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms, decompositions and ledger after facet operations (subject, label, base, axis, value).

    Each adds a decomposition row, takes the term away, and marks its id as faceted; tables are never changed in place.
    """
    gone = operations.select("subject").distinct()
    rows = operations.select(F.col("label").alias("term"), "base", "axis", "value")
    done = ledger.join(gone.withColumn("_gone", F.lit(True)), "subject", "left")
    done = done.withColumn("status", F.when(F.col("_gone"), "faceted").otherwise(F.col("status"))).drop("_gone")
    return terms.join(gone, "subject", "left_anti"), decompositions.unionByName(rows), done


def relabel(rows: DataFrame, column: str, renames: DataFrame) -> DataFrame:
    """rows with the labels of one column replaced by renames (old, new)."""
    named = renames.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return rows.join(named, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def retired(ledger: DataFrame, merges: DataFrame) -> DataFrame:
    """The ledger (subject, status, replaced_by) after merges (subject, into)."""
    into = merges.select("subject", F.col("into").alias("_into"))
    out = ledger.join(into, "subject", "left")
    out = out.withColumn("status", F.when(F.col("_into").isNotNull(), "merged").otherwise(F.col("status")))
    return out.withColumn("replaced_by", F.coalesce("_into", "replaced_by")).drop("_into")


def mapping_fill(operations: DataFrame, names: DataFrame, member: str, categories: tuple[str, str]) -> DataFrame:
    """Mapping rows of adopted or rejected mappings: operations (subject, predicate, object, object_label, fit, negate).

    A label that is not given comes from names (object, name); membership rows get the fixed categories, and their fit
    unless they are negated.
    """
    known = names.select("object", F.col("name").alias("_name")).dropDuplicates(["object"])
    rows = operations.join(known, "object", "left")
    is_member = F.col("predicate") == member
    given = F.nullif(blank(F.col("object_label")), F.lit(""))
    return rows.select(
        "subject", "predicate", "object", F.coalesce(given, F.col("_name"), F.lit("")).alias("object_label"),
        F.when(is_member & ~F.col("negate"), blank(F.col("fit"))).otherwise("").alias("fit"), F.when(F.col("negate"), "Not").otherwise("").alias("modifier"),
        F.when(is_member, categories[0]).otherwise("").alias("subject_category"), F.when(is_member, categories[1]).otherwise("").alias("object_category"),
    )


def references(labels: DataFrame, places: DataFrame) -> DataFrame:
    """label, place, holder: where tables use a label. labels: (label, enum); places: (place, label, enum, holder).

    A place without an enum refers to the label in any.
    """
    rows = places.withColumnRenamed("enum", "_enum").join(labels, "label")
    return rows.where((blank(F.col("_enum")) == "") | (F.col("_enum") == F.col("enum"))).select("label", "place", "holder")


def promoted(terms: DataFrame, operations: DataFrame, status: str) -> DataFrame:
    """terms (subject, status) after promotions (subject)."""
    up = operations.select("subject").distinct().withColumn("_up", F.lit(True))
    return terms.join(up, "subject", "left").withColumn("status", F.when(F.col("_up"), F.lit(status)).otherwise(F.col("status"))).drop("_up")
