"""What pages show of a vocabulary: paths, mappings, slots and rules of classes, filters, reviews and subject rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import blank, first_mapping, holds_quoted, slugify
from lexiloom.operators.project import NONE_FOUND


def content_terms(subjects: DataFrame, enums: tuple[str, ...]) -> DataFrame:
    """Live subjects (kind, enum, retired) that are terms of these enums."""
    return subjects.where((F.col("kind") == "term") & ~F.coalesce(F.col("retired"), F.lit(False)) & F.col("enum").isin(*enums))


def browse_path(subjects: DataFrame, enum_pages: dict[str, str], class_pages: dict[str, str], term_pages: dict[str, str]) -> DataFrame:
    """subjects (kind, name, label, enum, owner_class, retired) with `path`, the page that shows them, or null.

    enum_pages and class_pages name enums and classes with pages of their own; term_pages name enums whose terms have.
    """
    page = lambda pages, name, kind: F.coalesce(*(F.when(name == n, F.lit(p)) for n, p in pages.items()), F.concat(F.lit(f"/schema/{kind}/"), name)) if pages else F.concat(F.lit(f"/schema/{kind}/"), name)
    kind, enum = F.col("kind"), F.col("enum")
    own = F.coalesce(*(F.when(enum == n, F.concat(F.lit(f"{p}/"), slugify(F.coalesce("label", F.lit(""))))) for n, p in term_pages.items())) if term_pages else F.lit(None).cast("string")
    path = (
        F.when(F.coalesce(F.col("retired"), F.lit(False)), F.lit(None).cast("string"))
        .when(kind == "class", page(class_pages, F.col("name"), "class"))
        .when(kind == "enum", page(enum_pages, F.col("name"), "enum"))
        .when(kind == "term", F.coalesce(own, page(enum_pages, enum, "enum")))
        .when((kind == "slot") & F.col("owner_class").isNotNull(), page(class_pages, F.col("owner_class"), "class"))
        .when(kind == "usage", page(class_pages, F.substring_index("name", "/", 1), "class"))
    )
    return subjects.withColumn("path", path)


def enriched(terms: DataFrame, mappings: DataFrame, members: DataFrame, prefix: str) -> DataFrame:
    """terms (term_id, element_type, exact, close, broad, related: arrays) with the mapping that a page shows, and their members.

    mappings: (row_no, term_id, predicate, object, object_label): a term's last row counts; without one, the first slot
    with an object of this prefix. members: (row_no, term_id, object, object_label), rows that found nothing aside: their
    objects are listed in row order, and element types by the label that a row gives them.
    """
    last = mappings.groupBy("term_id").agg(F.max_by(F.struct("predicate", "object", "object_label"), "row_no").alias("row"))
    slots = {f"{n}Match": F.col(n) for n in ("exact", "close", "broad", "related")}
    kept = members.where(F.col("object") != NONE_FOUND)
    rows = kept.groupBy("term_id").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "object", F.coalesce("object_label", F.lit("")).alias("label")))).alias("rows")
    )
    out = terms.join(last, "term_id", "left").join(rows, "term_id", "left")
    slot = first_mapping(slots, prefix)
    listed = F.coalesce("rows", F.array().cast("array<struct<row_no: bigint, object: string, label: string>>"))
    types = F.filter(F.transform(F.split(F.coalesce("element_type", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    label = lambda o: F.coalesce(F.get(F.filter(listed, lambda r: r["object"] == o), 0)["label"], F.lit(""))
    return out.select(
        "term_id", F.coalesce(F.col("row.predicate"), slot["predicate"]).alias("predicate"), F.coalesce(F.col("row.object"), slot["object"]).alias("object"),
        F.when(F.col("row").isNotNull(), "row").when(slot.isNotNull(), "slot").otherwise("none").alias("source"),
        F.array_join(F.transform(listed, lambda r: r["object"]), "|").alias("members"), F.array_join(F.transform(types, lambda o: F.concat(o, F.lit("="), label(o))), "|").alias("types"),
    )


def already_mapped(suggestions: DataFrame, rows: DataFrame, iri: str, prefix: str) -> DataFrame:
    """Suggestions (subject, object) for which a mapping row (subject, object), positive or negated, is there already.

    An object's IRI counts as its CURIE.
    """
    short = lambda c: F.when(F.col(c).rlike(f"^{iri}.+"), F.concat(F.lit(f"{prefix}:"), F.regexp_extract(c, f"^{iri}(.+)$", 1))).otherwise(F.col(c))
    known = rows.select("subject", short("object").alias("_object")).distinct()
    return suggestions.withColumn("_object", short("object")).join(known, ["subject", "_object"], "left_semi").drop("_object")


def slot_group(name: Column) -> Column:
    return F.when(name.startswith("edge"), "edge properties").otherwise("feature properties")


def slot_links(slots: DataFrame, rules: DataFrame, vocabularies: DataFrame, default_range: str = "string") -> DataFrame:
    """class, slot, group, range, required, rule, path, terms of slots (class, slot, range, required).

    rules: (class, slot, rule); vocabularies: (enum, path, terms), which a slot links to whose range is the enum.
    """
    ranged = slots.withColumn("range", F.coalesce(F.nullif(blank(F.col("range")), F.lit("")), F.lit(default_range)))
    linked = vocabularies.select(F.col("enum").alias("range"), "path", "terms")
    out = ranged.join(rules.groupBy("class", "slot").agg(F.max("rule").alias("rule")), ["class", "slot"], "left").join(linked, "range", "left")
    return out.select("class", "slot", slot_group(F.col("slot")).alias("group"), "range", F.coalesce("required", F.lit(False)).alias("required"), "rule", "path", "terms")


def rule_summaries(conditions: DataFrame) -> DataFrame:
    """class, rule_no, summary, slots of rules given as conditions (class, rule_no, side, ord, slot, test, value).

    side is `pre`, `any` (alternatives of a condition, which name the slot alone unless it equals a text), `post` or `one`
    (of which exactly one is needed); test is equals, number, presence or null for a bare slot.
    """
    test = F.col("test")
    text = (
        F.when(test == "equals", F.concat("slot", F.lit(' = "'), "value", F.lit('"')))
        .when(test == "number", F.concat("slot", F.lit(" is true")))
        .when(test == "presence", F.concat("slot", F.lit(" is present")))
        .otherwise(F.col("slot"))
    )
    text = F.when((F.col("side") == "any") & F.coalesce(test != "equals", F.lit(True)), F.col("slot")).otherwise(text)
    rows = conditions.withColumn("text", text)
    listed = lambda side, column, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("ord", column)))), lambda s: s[column]), sep)
    per = rows.groupBy("class", "rule_no").agg(
        listed("pre", "text", " and ").alias("pre"), listed("any", "text", " or ").alias("alternatives"), listed("post", "slot", ", ").alias("post"), listed("one", "slot", " / ").alias("one"), listed("one", "slot", ", ").alias("one_slots")
    )
    condition = F.array_join(F.filter(F.array("pre", "alternatives"), lambda x: x != ""), " and ")
    both = F.array_compact(
        F.array(
            F.when(F.col("one") != "", F.struct(F.concat(F.lit("Exactly one of "), "one", F.lit(" is required.")).alias("summary"), F.col("one_slots").alias("slots"))),
            F.when(F.col("post") != "", F.struct(F.concat(F.lit("When "), condition, F.lit(": "), "post", F.lit(" required.")).alias("summary"), F.col("post").alias("slots"))),
        )
    )
    return per.select("class", "rule_no", F.explode(both).alias("r")).select("class", "rule_no", "r.summary", "r.slots")


def citations(terms: DataFrame, requests: DataFrame, ngram: int = 1) -> DataFrame:
    """subject, request: requests (request, document: JSON text) whose strings hold a term's label or id as a whole.

    terms: (subject, label, term_id). Strings of a document are taken apart and met by equality, then confirmed.
    """
    keys = terms.select("subject", F.explode(F.array_compact(F.array(F.nullif("label", F.lit("")), F.nullif("term_id", F.lit(""))))).alias("key"))
    strings = requests.select("request", "document", F.explode(F.array_distinct(F.regexp_extract_all("document", F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)))).alias("raw"))
    strings = strings.withColumn("key", F.get_json_object(F.concat(F.lit('{"k":"'), "raw", F.lit('"}')), "$.k"))
    return strings.join(keys, "key").where(holds_quoted(F.col("document"), F.col("key"))).select("subject", "request").distinct()


def suggestions(report: DataFrame) -> DataFrame:
    """finding, object, label, source, score of a mapping report's rows (id, term_id, term_name, ontology, similarity): one a finding, the best."""
    best = F.max_by(F.struct("term_id", "term_name", "ontology", "similarity"), F.struct("similarity", "term_id"))
    rows = report.where("id is not null").groupBy("id").agg(best.alias("s"))
    return rows.select(F.col("id").alias("finding"), F.col("s.term_id").alias("object"), F.col("s.term_name").alias("label"), F.col("s.ontology").alias("source"), F.col("s.similarity").alias("score"))


def filtered(rows: DataFrame, equal: dict[str, str | None], within: dict[str, tuple[str, ...]], holds: tuple[str, tuple[str, ...]] | None, at_least: dict[str, float] | None = None) -> DataFrame:
    """Rows that meet every given condition: columns that equal, are of a list, reach a number, or hold a text in one of several columns.

    A condition of None, an empty list or an empty text is not given; texts are compared without case.
    """
    out = rows
    for column, value in equal.items():
        out = out if value is None else out.where(F.col(column) == value)
    for column, values in within.items():
        out = out if not values else out.where(F.col(column).isin(*values))
    for column, least in (at_least or {}).items():
        out = out.where(F.col(column) >= least)
    if holds and holds[0].strip():
        found = F.lit(False)
        for column in holds[1]:
            found = found | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(holds[0].strip().lower()))
        out = out.where(found)
    return out


# Review tracks and types: track | type | kinds | rules; a type without rules takes what no other one of its track does.
REVIEWS = """
vocabulary | links | term subset enum | mapping-suggestion no-mapping-at-all unmapped-high-usage unreviewed-mapping coverage-gap
vocabulary | duplicates | term subset enum | similar-terms residual-compound inline-enum
vocabulary | keep-or-cut | term subset enum | zero-usage-term orphan-facet-value
vocabulary | definitions | term subset enum | terse-description enum-value-no-description todo-marker
vocabulary | signoff | term subset enum |
schema | fields | class slot usage module | required-policy slot-no-examples
schema | definitions | class slot usage module | terse-description todo-marker
schema | links | class slot usage module | class-no-alignment mapping-target-is-doc-link
schema | structure | class slot usage module | shared-slot
schema | signoff | class slot usage module |
"""


def review_items(queue: DataFrame, found: DataFrame) -> DataFrame:
    """subject, track, type of queue rows (subject, kind): every type with a rule among the subject's findings, else the track's fallback.

    found: (subject, rule). A kind without a track gives no row.
    """
    types = [[part.strip() for part in line.split("|")] for line in REVIEWS.strip().splitlines()]
    spark = queue.sparkSession
    ruled = spark.createDataFrame([(t, k, kind, rule) for t, k, kinds, rules in types for kind in kinds.split() for rule in rules.split()], "track string, type string, kind string, rule string")
    last = spark.createDataFrame([(t, k, kind) for t, k, kinds, rules in types if not rules for kind in kinds.split()], "track string, type string, kind string")
    matched = queue.join(found.select("subject", "rule"), "subject").join(F.broadcast(ruled), ["kind", "rule"]).select("subject", "track", "type").distinct()
    rest = queue.join(matched.select("subject").distinct(), "subject", "left_anti").join(F.broadcast(last), "kind").select("subject", "track", "type")
    return matched.unionByName(rest.distinct())


# What a rule is called in plain words: pattern with named groups, text with its groups, text where the pattern does not fit.
# {n:,} is a number with separators, {score:.0%} a share in percent; {message} is the finding's own text, {other} the other subject's label.
REASONS = {
    "no-mapping-at-all": ("", "Not linked to any outside ontology.", ""),
    "unmapped-high-usage": (r"has (?<n>\d+) files", "Used by {n:,} files, but not linked to any outside ontology.", "Used by many files, but not linked to any outside ontology."),
    "unreviewed-mapping": (r"' (?<link>\S+ \S+) has no mapping", "Has a link nobody has checked: {link}.", "Has a link nobody has checked: {message}."),
    "class-no-alignment": ("", "Does not point to any outside standard.", ""),
    "coverage-gap": ("", "The automatic matcher found nothing similar in other ontologies.", ""),
    "terse-description": (r"is (?<n>\d+) chars", "Definition is very short ({n} characters).", "Definition is very short."),
    "enum-value-no-description": ("", "Has no definition.", ""),
    "todo-marker": (r"comment (?<note>.*)$", "Has a TODO note: {note}", "Has a TODO note: {message}"),
    "similar-terms": (r"similarity (?<score>[\d.]+)", 'Reads almost the same as "{other}" ({score:.0%} similar).', 'Reads almost the same as "{other}".'),
    "residual-compound": (r"contains facet word\(s\) (?<words>.+?) and has no", 'Contains the facet word "{words}": it might be two ideas glued together.', "It might be two ideas glued together."),
    "inline-enum": (r"defined inside class module (?<module>\S+)", 'Defined inside the class module "{module}" rather than in a vocabulary module.', "Defined inside a class module rather than in a vocabulary module."),
    "shared-slot": (r"listed by (?<classes>[^;]+)", "Used by more than one class: {classes}.", "Used by more than one class."),
    "mapping-target-is-doc-link": (r"value (?<target>\S+) is a documentation page", "Points to a web page ({target}), not to a term.", "Points to a web page, not to a term."),
    "zero-usage-term": ("", "No file uses this term.", ""),
    "orphan-facet-value": ("", "Nothing else refers to this value.", ""),
    "required-policy": ("", "Marked required, but it is not an identifier. Every required field is extra work for adopters.", ""),
    "slot-no-examples": ("", "Has no examples.", ""),
}
#: Rules that are not shown, and those that are not where another rule is among the subject's.
HIDDEN, HIDDEN_BESIDE = ("mapping-suggestion",), {"no-mapping-at-all": ("unmapped-high-usage",)}


def _said(template: str, groups: dict[str, Column]) -> Column:
    """A template's text with its places filled."""
    parts = []
    for text, name, form in re.findall(r"([^{]*)(?:\{(\w+)(:[^}]*)?\})?", template):
        parts += [F.lit(text)] if text else []
        if name:
            group = groups[name]
            shown = {":,": lambda g: F.format_number(g.cast("long"), 0), ":.0%": lambda g: F.concat(F.format_number(F.bround(100 * g.cast("double"), 0), 0), F.lit("%")), "": F.trim}
            parts.append(shown[form](group))
    return F.concat(*parts)


def reasons(found: DataFrame) -> DataFrame:
    """subject, rule, reason: findings (subject, rule, message, maybe other: the other subject's label) in plain words.

    Hidden rules are left out; a rule without a text keeps its message. Where a pattern does not fit, its second text is
    taken. A finding without another subject names none: its label is empty.
    """
    rule, message = F.col("rule"), F.coalesce("message", F.lit(""))
    always = {"message": message, "other": F.coalesce("other", F.lit("")) if "other" in found.columns else F.lit("")}
    text = message
    for name, (pattern, full, short) in REASONS.items():
        said = F.lit(full)
        if pattern:
            names = re.findall(r"\(\?<(\w+)>", pattern)
            groups = {g: F.regexp_extract(message, pattern, k + 1) for k, g in enumerate(names)}
            said = F.when(message.rlike(pattern), _said(full, groups | always)).otherwise(_said(short, always))
        text = F.when(rule == name, said).otherwise(text)
    out = found.where(~rule.isin(*HIDDEN))
    for name, beside in HIDDEN_BESIDE.items():
        others = found.where(rule.isin(*beside)).select("subject").distinct().withColumn("_beside", F.lit(True))
        out = out.join(others, "subject", "left").where(~((F.col("rule") == name) & F.col("_beside").isNotNull())).drop("_beside")
    return out.select("subject", "rule", text.alias("reason"))


def filtered_groups(rows: DataFrame, group: str, shown: DataFrame) -> DataFrame:
    """The groups of rows with how many of their rows are shown (a subset of rows), those with none left out: group, n, of."""
    all_rows = rows.groupBy(group).agg(F.count("*").alias("of"))
    return shown.groupBy(group).agg(F.count("*").alias("n")).join(all_rows, group).select(group, "n", "of")


def not_decided(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows (subject) of which no decision (subject, status) is pending or applied."""
    settled = decisions.where("status in ('pending', 'applied')").select("subject").distinct()
    return rows.join(settled, "subject", "left_anti")


def subject_index(subjects: DataFrame, states: DataFrame, found: DataFrame, latest: DataFrame, prompts: DataFrame) -> DataFrame:
    """sid, kind, state, score, findings, lint, latest, prompts of every subject (sid, kind).

    states: (sid, state, score); found: (sid, id, source) of open findings; latest: (sid, id); prompts: (sid, prompt).
    """
    counts = found.groupBy("sid").agg(F.count_distinct("id").alias("findings"), F.count_distinct(F.when(F.col("source") == "schema_lint", F.col("id"))).alias("lint"))
    asked = prompts.groupBy("sid").agg(F.array_join(F.array_sort(F.collect_set("prompt")), "|").alias("prompts"))
    out = subjects.select("sid", "kind").join(states, "sid", "left").join(counts, "sid", "left").join(latest.select("sid", F.col("id").alias("latest")), "sid", "left").join(asked, "sid", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "sid", "kind", F.coalesce("state", F.lit("unreviewed")).alias("state"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("findings", zero).alias("findings"), F.coalesce("lint", zero).alias("lint"), "latest", F.coalesce("prompts", F.lit("")).alias("prompts")
    )


def machine_definitions(terms: DataFrame, machine: DataFrame) -> DataFrame:
    """subject of terms (subject, description) whose description is still the machine's (subject, text), white space aside."""
    same = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return terms.join(machine, "subject").where(same(F.col("description")) == same(F.col("text"))).select("subject")


def usage_panel(usage: DataFrame) -> DataFrame:
    """sid, text, seeds of usage (sid, files, datasets, labels): what a subject's page says of its use."""
    number = lambda c: F.format_number(F.coalesce(F.col(c), F.lit(0)), 0)
    return usage.select("sid", F.concat(number("files"), F.lit(" files in "), number("datasets"), F.lit(" datasets.")).alias("text"), F.coalesce("labels", F.lit("")).alias("seeds"))
