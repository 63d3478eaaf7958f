"""Chains, rollups, projections and schema graphs over parts, orders, nations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import project, resolve
from lexiloom.plans.registry import Tables, query


def _seeds(t: Tables) -> DataFrame:
    """Seed labels: type and name of each part, broken down by edges to the name, and to its last word."""
    return t.part.select(F.concat_ws(" ", "p_type", "p_name").alias("node"), "p_name").distinct()


def _last(c: str):
    return F.regexp_extract(c, "([^ ]+)$", 1)


def _edges(t: Tables) -> DataFrame:
    seeds = _seeds(t)
    short = t.part.select("p_name").distinct().where(F.col("p_name").contains(" "))
    return seeds.select(F.col("node").alias("src"), F.col("p_name").alias("dst")).union(short.select("p_name", _last("p_name")))


def _live(t: Tables) -> DataFrame:
    """Names that are live early, and last words but two."""
    words = t.part.select(_last("p_name").alias("node")).distinct()
    early = t.part.where("p_partkey % 7 = 0").select(F.col("p_name").alias("node"))
    return words.where("length(node) % 5 <> 0").union(early).distinct()


_CHAIN = """
    seeds AS (SELECT DISTINCT p_type || ' ' || p_name AS node, p_name FROM part),
    edges AS (SELECT node AS src, p_name AS dst FROM seeds UNION ALL SELECT DISTINCT p_name, regexp_extract(p_name, '([^ ]+)$', 1) FROM part WHERE p_name LIKE '% %'),
    live AS (SELECT DISTINCT node FROM (SELECT DISTINCT regexp_extract(p_name, '([^ ]+)$', 1) AS node FROM part) WHERE length(node) % 5 <> 0
             UNION SELECT p_name FROM part WHERE p_partkey % 7 = 0),
    walk(node, pos, steps) AS (
      SELECT node, node, 0 FROM seeds
      UNION ALL SELECT w.node, e.dst, w.steps + 1 FROM walk w JOIN edges e ON w.pos = e.src WHERE w.pos NOT IN (SELECT node FROM live)),
    ends AS (SELECT node, arg_max(pos, steps) AS chain_end, CAST(max(steps) AS BIGINT) AS steps FROM walk GROUP BY node)"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT node, chain_end, steps, chain_end IN (SELECT node FROM live) AS resolved FROM ends")
def facet_chain(t: Tables) -> DataFrame:
    ends = resolve.chain_ends(_seeds(t), _edges(t), _live(t))
    return ends.withColumn("steps", F.col("steps").cast("long"))


def _resolved(t: Tables) -> DataFrame:
    live = _live(t).select(F.col("node").alias("label"), F.concat(F.lit("id:"), "node").alias("target"))
    words = t.part.select(_last("p_name").alias("w")).distinct()
    delegated = _seeds(t).where("length(node) % 11 = 0").select(F.col("node").alias("label"), F.concat(F.lit("out:"), "p_name").alias("target"))
    crosswalk = words.where("length(w) % 5 = 0 and w < 'm'").select(F.col("w").alias("label"), F.concat(F.lit("old:"), "w").alias("target"))
    return resolve.resolve_labels(_seeds(t).select(F.col("node").alias("label")), live, resolve.chain_ends(_seeds(t), _edges(t), _live(t)), delegated, crosswalk)


_RESOLVED = f"""{_CHAIN},
    words AS (SELECT DISTINCT regexp_extract(p_name, '([^ ]+)$', 1) AS w FROM part),
    deleg AS (SELECT node AS label, min('out:' || p_name) AS target FROM seeds WHERE length(node) % 11 = 0 GROUP BY node),
    cross_w AS (SELECT w AS label, 'old:' || w AS target FROM words WHERE length(w) % 5 = 0 AND w < 'm'),
    res AS (
      SELECT e.node AS label,
             CASE WHEN l.node IS NOT NULL THEN 'id:' || l.node WHEN c.node IS NOT NULL THEN 'id:' || c.node WHEN d.target IS NOT NULL THEN d.target ELSE x.target END AS target,
             CASE WHEN l.node IS NOT NULL THEN 'live' WHEN c.node IS NOT NULL THEN 'chain' WHEN d.target IS NOT NULL THEN 'delegated' WHEN x.target IS NOT NULL THEN 'crosswalk' ELSE 'unresolved' END AS how
      FROM ends e LEFT JOIN live l ON e.node = l.node LEFT JOIN live c ON e.chain_end = c.node LEFT JOIN deleg d ON e.node = d.label LEFT JOIN cross_w x ON e.chain_end = x.label)"""


@query(f"WITH RECURSIVE {_RESOLVED} SELECT label, target, how FROM res")
def precedence(t: Tables) -> DataFrame:
    return _resolved(t)


@query(
    f"""
    WITH RECURSIVE {_RESOLVED},
    u AS (SELECT p_type || ' ' || p_name AS label, count(*) AS files, count(DISTINCT l_orderkey) AS datasets FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    f AS (SELECT target, sum(files) AS files, sum(datasets) AS datasets, string_agg(r.label, '|' ORDER BY r.label) AS labels
          FROM res r JOIN u ON r.label = u.label WHERE how <> 'delegated' AND target IS NOT NULL GROUP BY target),
    a AS (SELECT 'id:' || node AS target FROM live UNION SELECT target FROM cross_w)
    SELECT a.target, CAST(coalesce(files, 0) AS BIGINT) AS files, CAST(coalesce(datasets, 0) AS BIGINT) AS datasets, coalesce(labels, '') AS labels FROM a LEFT JOIN f ON a.target = f.target
    """
)
def usage_rollup(t: Tables) -> DataFrame:
    label = F.concat_ws(" ", "p_type", "p_name").alias("label")
    # lines of a part and order are counted before labels are joined
    lines = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    lines = lines.join(t.part.select("p_partkey", label), F.col("l_partkey") == F.col("p_partkey"))
    usage = lines.groupBy("label").agg(F.sum("n").alias("files"), F.count_distinct("l_orderkey").alias("datasets"))
    words = t.part.select(_last("p_name").alias("w")).distinct()
    live = _live(t).select(F.concat(F.lit("id:"), "node").alias("target")).union(words.where("length(w) % 5 = 0 and w < 'm'").select(F.concat(F.lit("old:"), "w")))
    return resolve.usage_rollup(live, _resolved(t), usage)


@query(
    """
    WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey + 5) AS dst FROM nation WHERE n_nationkey < 18 AND n_nationkey % 4 <> 0
                         UNION ALL SELECT 'n22', 'n23' UNION ALL SELECT 'n23', 'n22'),
    w(node, pos, steps, seen) AS (
      SELECT 'n' || n_nationkey, 'n' || n_nationkey, 0, ['n' || n_nationkey] FROM nation
      UNION ALL SELECT w.node, e.dst, w.steps + 1, list_append(w.seen, e.dst) FROM w JOIN e ON w.pos = e.src WHERE NOT list_contains(w.seen, e.dst)),
    d AS (SELECT node, arg_max(pos, steps) AS chain_end, CAST(max(steps) AS BIGINT) AS steps FROM w GROUP BY node)
    SELECT node, chain_end, steps, chain_end NOT IN (SELECT src FROM e) AS resolved FROM d
    """
)
def alias_resolution(t: Tables) -> DataFrame:
    ends = resolve.chain_ends(*_aliases(t))
    return ends.withColumn("steps", F.col("steps").cast("long"))


def _aliases(t: Tables) -> tuple[DataFrame, DataFrame]:
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    key = F.col("n_nationkey")
    edges = t.nation.where((key < 18) & (key % 4 != 0)).select(name(key).alias("src"), name(key + 5).alias("dst"))
    loop = t.spark.createDataFrame([("n22", "n23"), ("n23", "n22")], "src string, dst string")
    return t.nation.select(name(key).alias("node")), edges.union(loop)


@query(
    """
    WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey + 5) AS dst FROM nation WHERE n_nationkey < 18 AND n_nationkey % 4 <> 0),
    w(node, pos) AS (SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation UNION ALL SELECT w.node, e.dst FROM w JOIN e ON w.pos = e.src)
    SELECT pos AS chain_end, string_agg(node, '|' ORDER BY node) AS former FROM w WHERE node <> pos AND pos NOT IN (SELECT src FROM e) AND pos NOT IN ('n22', 'n23') AND node NOT IN ('n22', 'n23')
    GROUP BY pos
    """
)
def former_names(t: Tables) -> DataFrame:
    out = resolve.former_names(resolve.chain_ends(*_aliases(t)))
    return out.select("chain_end", F.array_join("former", "|").alias("former"))


@query(
    """
    WITH k AS (SELECT o_orderkey, o_orderstatus, 'C' || o_custkey AS label FROM orders),
    s AS (SELECT 'C' || c_custkey AS label, c_custkey AS subject_id, c_custkey % 10 = 0 AS retired, c_mktsegment AS enum FROM customer WHERE c_acctbal >= 0)
    SELECT coalesce(CASE WHEN s.subject_id IS NULL THEN 'unknown label' WHEN retired THEN 'retired' WHEN enum NOT IN ('BUILDING', 'MACHINERY') THEN 'wrong enum' END, 'none') AS error, count(*) AS n
    FROM k LEFT JOIN s ON k.label = s.label GROUP BY 1
    """
)
def label_resolution(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("C"), F.col(c).cast("string")).alias("label")
    rows = t.orders.select("o_orderkey", name("o_custkey"))
    subjects = t.customer.where("c_acctbal >= 0").select(name("c_custkey"), F.col("c_custkey").alias("subject_id"), (F.col("c_custkey") % 10 == 0).alias("retired"), F.col("c_mktsegment").alias("enum"))
    found = resolve.subject_errors(rows, subjects, ("BUILDING", "MACHINERY"))
    return found.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


_ROWS = """
    m AS (SELECT p_partkey AS row_no, p_type AS subject, p_type || '!' AS label, p_brand AS object,
                 CASE p_size % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'broad' ELSE 'approximate' END AS fit,
                 CASE p_size % 4 WHEN 0 THEN 'exactMatch' WHEN 1 THEN 'closeMatch' WHEN 2 THEN 'has_element_type' ELSE 'related' END AS predicate,
                 CASE WHEN p_size % 13 = 0 THEN 'Not' ELSE '' END AS modifier FROM part)"""


def _mapping_rows(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("row_no"), F.col("p_type").alias("subject"), F.concat("p_type", F.lit("!")).alias("label"), F.col("p_brand").alias("object"),
        F.when(size % 3 == 0, "exact").when(size % 3 == 1, "broad").otherwise("approximate").alias("fit"),
        F.when(size % 4 == 0, "exactMatch").when(size % 4 == 1, "closeMatch").when(size % 4 == 2, "has_element_type").otherwise("related").alias("predicate"),
        F.when(size % 13 == 0, "Not").otherwise("").alias("modifier"),
    )


@query(
    f"""
    WITH {_ROWS}, o AS (SELECT subject, object, min(row_no) AS first FROM m GROUP BY 1, 2),
    g AS (SELECT subject, arg_min(label, row_no) AS label, arg_min(fit, row_no) AS fit FROM m GROUP BY 1),
    l AS (SELECT subject, count(*) AS n, string_agg(object, '|' ORDER BY first) AS objects FROM o GROUP BY 1)
    SELECT g.subject, g.label, g.fit, l.n, l.objects, CASE WHEN l.n = 1 THEN 'iri' ELSE 'unionOf' END AS form FROM g JOIN l ON g.subject = l.subject
    """
)
def axiom_grouping(t: Tables) -> DataFrame:
    return project.axioms(_mapping_rows(t)).withColumn("n", F.col("n").cast("long"))


def _list(where: str) -> str:
    return f"coalesce((SELECT string_agg(object, '|' ORDER BY first) FROM (SELECT object, min(row_no) AS first FROM m x WHERE x.subject = s.subject AND {where} GROUP BY object)), '')"


@query(
    f"""
    WITH {_ROWS}, s AS (SELECT subject, count(*) FILTER (modifier <> 'Not' AND predicate <> 'related') AS other, count(*) FILTER (modifier <> 'Not' AND predicate = 'related') AS rel,
                               count(DISTINCT fit) FILTER (modifier <> 'Not' AND predicate = 'has_element_type') AS fits FROM m GROUP BY subject),
    d AS (SELECT subject, {_list("modifier <> 'Not' AND predicate = 'exactMatch'")} AS exact_mappings, {_list("modifier <> 'Not' AND predicate = 'closeMatch'")} AS close_mappings,
                 {_list("modifier = 'Not'")} AS negated, {_list("modifier <> 'Not' AND predicate = 'has_element_type'")} AS members, other, rel, fits FROM s)
    SELECT subject, exact_mappings, close_mappings, negated, CASE WHEN members <> '' THEN members WHEN other = 0 AND rel > 0 THEN 'not_applicable' ELSE '' END AS element_type, fits > 1 AS conflict FROM d
    """
)
def desired_state(t: Tables) -> DataFrame:
    return project.desired_state(_mapping_rows(t), {"exactMatch": "exact_mappings", "closeMatch": "close_mappings"}, "has_element_type", "related")


_CLASSES = """
    edges AS (SELECT 'S' || s_suppkey AS class, 'N' || s_nationkey AS parent, 0 AS ord FROM supplier
              UNION ALL SELECT 'S' || s_suppkey, 'X' || (s_suppkey % 3), CAST(1 + s_suppkey % 2 AS INTEGER) FROM supplier
              UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 0 FROM nation),
    slots AS (SELECT 'R' || r_regionkey AS class, 'name' AS slot FROM region UNION ALL SELECT 'R' || r_regionkey, 'size' FROM region WHERE r_regionkey % 2 = 0
              UNION ALL SELECT 'N' || n_nationkey, 'name' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'N' || n_nationkey, 'code' FROM nation
              UNION ALL SELECT 'S' || s_suppkey, 'balance' FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'code' FROM supplier WHERE s_suppkey % 4 = 0
              UNION ALL SELECT 'X' || x, 'size' FROM range(3) r(x) UNION ALL SELECT 'X1', 'name')"""


@query(
    f"""
    WITH RECURSIVE {_CLASSES},
    up(class, ancestor, distance, path) AS (
      SELECT class, class, 0, '' FROM (SELECT class FROM slots UNION SELECT class FROM edges)
      UNION ALL SELECT u.class, e.parent, u.distance + 1, u.path || lpad(CAST(999 - e.ord AS VARCHAR), 3, '0') FROM up u JOIN edges e ON u.ancestor = e.class)
    SELECT u.class, s.slot, CASE WHEN distance > 0 THEN ancestor END AS inherited_from, CAST(distance AS BIGINT) AS distance
    FROM up u JOIN slots s ON u.ancestor = s.class QUALIFY row_number() OVER (PARTITION BY u.class, s.slot ORDER BY path, distance, ancestor) = 1
    """
)
def class_slots(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s, n, r = t.supplier, t.nation, t.region
    edges = s.select(name("S", "s_suppkey").alias("class"), name("N", "s_nationkey").alias("parent"), F.lit(0).alias("ord"))
    edges = edges.union(s.select(name("S", "s_suppkey"), F.concat(F.lit("X"), (F.col("s_suppkey") % 3).cast("string")), (1 + F.col("s_suppkey") % 2).cast("int")))
    edges = edges.union(n.select(name("N", "n_nationkey"), name("R", "n_regionkey"), F.lit(0)))
    slots = r.select(name("R", "r_regionkey").alias("class"), F.lit("name").alias("slot")).union(r.where("r_regionkey % 2 = 0").select(name("R", "r_regionkey"), F.lit("size")))
    slots = slots.union(n.where("n_nationkey % 3 = 0").select(name("N", "n_nationkey"), F.lit("name"))).union(n.select(name("N", "n_nationkey"), F.lit("code")))
    slots = slots.union(s.select(name("S", "s_suppkey"), F.lit("balance"))).union(s.where("s_suppkey % 4 = 0").select(name("S", "s_suppkey"), F.lit("code")))
    slots = slots.union(t.spark.createDataFrame([("X0", "size"), ("X1", "size"), ("X2", "size"), ("X1", "name")], "class string, slot string"))
    return project.class_slots(edges, slots).withColumn("distance", F.col("distance").cast("long"))


@query(
    """
    WITH e AS (SELECT DISTINCT s_nationkey AS source, c_nationkey AS target FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey <> c_nationkey)
    SELECT CAST(target AS VARCHAR) AS target, count(*) AS n, string_agg(CAST(source AS VARCHAR), '|' ORDER BY CAST(source AS VARCHAR)) AS sources FROM e GROUP BY target
    """
)
def reference_graph(t: Tables) -> DataFrame:
    edges = t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey"))
    return project.referenced_by(edges.select(F.col("s_nationkey").cast("string").alias("source"), F.col("c_nationkey").cast("string").alias("target")))


@query(
    """
    SELECT CASE WHEN c.r IS NOT NULL THEN 'class' WHEN e.r IS NOT NULL THEN 'enum' ELSE 'scalar' END AS kind, count(*) AS n
    FROM part LEFT JOIN (SELECT DISTINCT p_type AS r FROM part WHERE p_size < 3) c ON p_type = c.r LEFT JOIN (SELECT DISTINCT p_type AS r FROM part WHERE p_size BETWEEN 3 AND 5) e ON p_type = e.r
    GROUP BY 1
    """
)
def range_classification(t: Tables) -> DataFrame:
    name = F.col("p_type").alias("name")
    slots = t.part.select(F.col("p_partkey").alias("slot"), F.col("p_type").alias("range"))
    found = project.range_kind(slots, t.part.where("p_size < 3").select(name), t.part.where("p_size between 3 and 5").select(name))
    return found.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    """
    WITH tr AS (SELECT n_nationkey AS id, lower(n_name) AS lo, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') AS slug, n_regionkey AS cat FROM nation),
    me AS (SELECT a.n_nationkey AS id, CASE WHEN a.n_nationkey % 2 = 0 THEN b.n_name ELSE regexp_replace(lower(b.n_name), '[^a-z0-9]+', '_', 'g') END AS mention FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 3) % 25),
    x AS (SELECT DISTINCT me.id AS term_id, tr.id AS related_id FROM me JOIN tr ON (lower(me.mention) = tr.lo OR lower(me.mention) = tr.slug) AND me.id <> tr.id),
    y AS (SELECT a.id AS term_id, b.id AS related_id FROM tr a JOIN tr b ON a.cat = b.cat AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.id) <= 3)
    SELECT term_id, related_id, 'mention' AS how FROM x UNION ALL SELECT term_id, related_id, 'category' FROM y
    """
)
def related_terms(t: Tables) -> DataFrame:
    from lexiloom.functions.text import slugify

    terms = t.nation.select(F.col("n_nationkey").alias("term_id"), F.col("n_name").alias("name"), slugify(F.col("n_name")).alias("slug"), F.col("n_regionkey").alias("category"))
    other = terms.select(F.col("term_id").alias("o"), F.col("name").alias("o_name"), F.col("slug").alias("o_slug"))
    mentions = terms.join(other, (F.col("term_id") * 7 + 3) % 25 == F.col("o")).select("term_id", F.when(F.col("term_id") % 2 == 0, F.col("o_name")).otherwise(F.col("o_slug")).alias("mention"))
    return project.related_terms(terms, mentions, 3)
