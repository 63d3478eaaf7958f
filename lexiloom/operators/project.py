"""Mapping rows projected to terms: desired state, axioms, class inheritance, reference graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import blank, pipe_list, same_set
from lexiloom.session import durable


#: Fixed value: the object of a row that says that no object was found.
NONE_FOUND = "sssom:NoTermFound"


def in_row_order(value: str, order: str = "first"):
    """Aggregate: the values of rows that are distinct already, in this order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def axioms(rows: DataFrame) -> DataFrame:
    """subject, label, fit, n, objects, form of rows (row_no, subject, label, fit, object).

    Objects are distinct in row order and joined by |; label and fit are the first row's; one object is an IRI, several
    are a union. Rows that say that nothing was found make no axiom. Rows that repeat an object are one before a subject's
    objects are gathered, so a subject's list is as long as it has objects, whatever its rows.
    """
    rows = rows.where(F.col("object") != NONE_FOUND)
    once = rows.groupBy("subject", "object").agg(F.min(F.struct("row_no", "label", "fit")).alias("r"))
    once = once.select("subject", "object", F.col("r.row_no").alias("first"), "r.label", "r.fit")
    per = once.groupBy("subject").agg(F.min_by("label", "first").alias("label"), F.min_by("fit", "first").alias("fit"), in_row_order("object").alias("o"))
    return per.select("subject", "label", "fit", F.size("o").alias("n"), F.array_join("o", "|").alias("objects"), F.when(F.size("o") == 1, "iri").otherwise("unionOf").alias("form"))


def turtle(axiom_rows: DataFrame, base: str, prefix: str) -> DataFrame:
    """value: lines of Turtle, a statement for each subject, in order of subjects when sorted by the writer."""
    iris = F.transform(F.split("objects", r"\|"), lambda o: F.concat(F.lit(f"<{base}"), F.replace(o, F.lit(":"), F.lit("_")), F.lit(">")))
    union = F.concat(F.lit("[ a owl:Class ; owl:unionOf ( "), F.array_join(iris, " "), F.lit(" ) ]"))
    body = F.when(F.col("n") == 1, iris[0]).otherwise(union)
    if not axiom_rows.where(F.startswith(F.concat(F.lit(prefix), "subject"), F.lit(base))).isEmpty():
        raise ValueError("a term of the target is the subject of a statement")
    return axiom_rows.select("subject", F.concat(F.lit(prefix), F.col("subject"), F.lit(" rdfs:subClassOf "), body, F.lit(" .")).alias("value"))


def desired_state(rows: DataFrame, slots: dict[str, str], member: str, related: str) -> DataFrame:
    """Per subject what its schema entry should say, from mapping rows (row_no, subject, predicate, object, fit, modifier).

    slots maps predicates to slot names, each a |-joined list of distinct objects in row order. Rows whose modifier is
    Not project nothing and are listed as negated. Objects of the `member` predicate make element_type;
    not_applicable stands where a subject has only the `related` predicate. conflict tells of several fits.
    """
    positive = blank(F.col("modifier")) != "Not"
    is_member = F.col("predicate") == member
    rows = rows.withColumn("_list", F.when(~positive, "negated").otherwise(F.col("predicate")))
    # an object counts once in a list: rows that repeat it are one before lists are gathered
    once = rows.groupBy("subject", "_list", "object").agg(F.min("row_no").alias("first"), F.count("*").alias("_n"), F.array_distinct(F.collect_set(F.when(positive & is_member, F.col("fit")))).alias("_fits"))
    in_list = lambda name: F.col("_list") == name
    pair = F.struct(F.col("first").alias("o"), F.col("object").alias("v"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, pair))), lambda p: p["v"]), "|")
    out = once.groupBy("subject").agg(
        *(listed(in_list(p)).alias(s) for p, s in slots.items()),
        listed(in_list("negated")).alias("negated"),
        listed(in_list(member)).alias("_members"),
        F.coalesce(F.sum(F.when(~in_list("negated") & ~in_list(related), F.col("_n"))), F.lit(0)).alias("_other"),
        F.coalesce(F.sum(F.when(in_list(related), F.col("_n"))), F.lit(0)).alias("_related"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_fits")))).alias("_fits"),
    )
    element = F.when(F.col("_members") != "", F.col("_members")).when((F.col("_other") == 0) & (F.col("_related") > 0), "not_applicable").otherwise("")
    return out.select("subject", *slots.values(), "negated", element.alias("element_type"), (F.col("_fits") > 1).alias("conflict"))


def _edits(have: list[str], want: list[str]) -> list[dict]:
    """How to get from one list to the other: what goes, comes and moves. The longest part that keeps its order stays."""
    from bisect import bisect_left
    from collections import Counter

    def numbered(values: list[str]) -> list[tuple[str, int]]:
        seen: Counter[str] = Counter()
        return [(v, seen.update([v]) or seen[v]) for v in values]

    a, b = numbered(have), numbered(want)
    place = {v: k for k, v in enumerate(b)}
    common = [(at, place[v]) for at, v in enumerate(a) if v in place]
    # the longest rising run of places, by its smallest ends
    ends, keys, before = [], [], {}
    for at, to in common:
        k = bisect_left(keys, to)
        before[at] = ends[k - 1] if k else None
        keys[k : k + 1], ends[k : k + 1] = [to], [at]
    stays, at = set(), ends[-1] if ends else None
    while at is not None:
        stays.add(at)
        at = before[at]
    left = set(a)
    out = [{"op": "delete", "object": v[0], "at": at, "to": None} for at, v in enumerate(a) if v not in place]
    out += [{"op": "move", "object": a[at][0], "at": at, "to": to} for at, to in common if at not in stays]
    return out + [{"op": "insert", "object": v[0], "at": None, "to": to} for to, v in enumerate(b) if v not in left]


def list_edits(lists: DataFrame) -> DataFrame:
    """subject, slot, same_set, edits of lists (subject, slot, have, want: arrays of texts) that differ.

    edits: (op: delete, insert or move, object, at: place in have, to: place in want), as few as get from one list to the
    other: what keeps its order in the longest common part stays. An object that a list repeats counts by its occurrences;
    a null list is an empty one; same_set tells that only the order or repeats differ. Rows are taken one by one in tasks.
    """
    empty = F.array().cast("array<string>")
    rows = lists.select("subject", "slot", F.coalesce("have", empty).alias("have"), F.coalesce("want", empty).alias("want"))
    rows = rows.where(F.col("have") != F.col("want")).withColumn("same_set", same_set(F.col("have"), F.col("want")))
    kind = pa.list_(pa.struct([("op", pa.string()), ("object", pa.string()), ("at", pa.int64()), ("to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = [_edits(h, w) for h, w in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(edits, kind)], names=["subject", "slot", "same_set", "edits"])

    fields = f"subject {rows.schema['subject'].dataType.simpleString()}, slot string, same_set boolean, edits array<struct<op: string, object: string, at: long, to: long>>"
    return rows.select("subject", "slot", "same_set", "have", "want").mapInArrow(run, fields)


def projection_edits(have: DataFrame, state: DataFrame, slots: tuple[str, ...]) -> DataFrame:
    """Edits (see list_edits) that turn the schema's slots into the desired state, slot by slot and in order.

    have: (subject, slot, ord, object) of the schema; state: rows of desired_state, whose lists are joined by |. Subjects
    of either side count; slots that are not listed are left alone.
    """
    per = have.where(F.col("slot").isin(*slots)).groupBy("subject", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "object"))), lambda s: s["object"]).alias("have"))
    stack = F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), pipe_list(F.col(s)).alias("want")) for s in slots)))
    want = state.select("subject", stack.alias("s")).select("subject", "s.slot", "s.want").where(F.size("want") > 0)
    return list_edits(per.join(want, ["subject", "slot"], "full"))


def ancestors(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """class, ancestor, path, distance of edges (class, parent, ord) and classes (class), each class its own at distance 0.

    Of several ways to an ancestor the one whose path comes first is kept. A round holds the ways of one more step, of each
    length the first, so that diamonds cost one row a length and not one for each way; there are as many rounds as the
    longest way up. What earlier rounds found is not shuffled again until all is known, and then once.
    A class that is its own ancestor is an error.
    """
    code = F.lpad((F.lit(10**9) - 1 - F.col("ord")).cast("string"), 9, "0")
    steps = durable(edges.select("class", "parent", code.alias("code")), "edges")
    order = F.struct("path", "distance")
    # with one step up from a class at most, there is one way to an ancestor and nothing to choose from
    single = steps.groupBy("class").count().where("count > 1").isEmpty()
    last = durable(classes.select("class").distinct().select("class", F.col("class").alias("ancestor"), F.lit("").alias("path"), F.lit(0).cast("long").alias("distance")), "ancestors")
    rounds = [last]
    while True:
        up = steps.join(last.withColumnRenamed("class", "parent"), "parent").select("class", "ancestor", F.concat("code", "path").alias("path"), (F.col("distance") + 1).alias("distance"))
        if not single:
            up = up.groupBy("class", "ancestor").agg(F.min(order).alias("o")).select("class", "ancestor", "o.path", "o.distance")
        last = durable(up, "up")
        if not last.where("class = ancestor").isEmpty():
            raise ValueError("a class is its own ancestor")
        if last.isEmpty():
            break
        rounds.append(last)
    found = reduce(DataFrame.unionByName, rounds)
    if single:
        return found
    return found.groupBy("class", "ancestor").agg(F.min(order).alias("o")).select("class", "ancestor", "o.path", "o.distance")


def class_slots(edges: DataFrame, slots: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """class, slot, inherited_from, distance of every slot a class has by itself or by inheritance.

    edges: (class, parent, ord), ord 0 for the parent and 1, 2 ... for mixins; slots: (class, slot). Own slots win over
    mixins' and those over the parent's; of mixins the later one wins; nearer ancestors win inside each. With usage
    (class, slot, override), also the override that the class which lists the slot has for it.
    """
    up = ancestors(edges, slots.select("class").union(edges.select("class")))
    found = up.join(slots.select(F.col("class").alias("ancestor"), "slot"), "ancestor")
    first = F.min(F.struct("path", "distance", "ancestor")).alias("first")
    out = found.groupBy("class", "slot").agg(first).select("class", "slot", F.col("first.ancestor").alias("ancestor"), F.col("first.distance").alias("distance"))
    inherited = F.when(F.col("distance") > 0, F.col("ancestor")).alias("inherited_from")
    if usage is None:
        return out.select("class", "slot", inherited, "distance")
    own = usage.select(F.col("class").alias("ancestor"), "slot", "override")
    return out.join(own, ["ancestor", "slot"], "left").select("class", "slot", inherited, "distance", "override")


def referenced_by(references: DataFrame) -> DataFrame:
    """target, n, sources (sorted, |-joined) of reference edges (source, target), self-references aside."""
    edges = references.where("source <> target").distinct()
    return edges.groupBy("target").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("source")), "|").alias("sources"))


def range_kind(slots: DataFrame, classes: DataFrame, enums: DataFrame) -> DataFrame:
    """slots (slot, range) with kind: class, enum or scalar."""
    c = classes.select(F.col("name").alias("range"), F.lit(True).alias("_c")).distinct()
    e = enums.select(F.col("name").alias("range"), F.lit(True).alias("_e")).distinct()
    kind = F.when(F.col("_c"), "class").when(F.col("_e"), "enum").otherwise("scalar")
    return slots.join(c, "range", "left").join(e, "range", "left").select("slot", "range", kind.alias("kind"))


def related_terms(terms: DataFrame, mentions: DataFrame, siblings: int = 8) -> DataFrame:
    """term_id, related_id, how: terms mentioned by name or slug, and up to `siblings` others of the category.

    terms: (term_id, name, slug, category); mentions: (term_id, mention). Either form of mention is an equality join.
    """
    from pyspark.sql import Window

    # a name's lower case and a slug are two keys of one target
    keys = terms.select(F.col("term_id").alias("related_id"), F.explode(F.array_distinct(F.array(F.lower("name"), F.col("slug")))).alias("key"))
    named = mentions.join(keys, F.lower("mention") == F.col("key")).select("term_id", "related_id").where("term_id <> related_id").distinct()
    named = named.withColumn("how", F.lit("mention"))
    # of a category's first siblings + 1 terms, those other than oneself; no pairs of a category are made
    first = terms.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("term_id"))).where(F.col("_n") <= siblings + 1)
    first = first.select("category", F.col("term_id").alias("related_id"))
    near = terms.join(first, "category").where("term_id <> related_id")
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("term_id").orderBy("related_id"))).where(F.col("_n") <= siblings)
    return named.unionByName(near.select("term_id", "related_id", F.lit("category").alias("how")))
