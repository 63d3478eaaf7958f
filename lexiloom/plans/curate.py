"""Checks, findings, lint, states and rollups over orders, parts, documents, customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import curation, reports, resolve, validate
from lexiloom.plans.match import _BEST, _PAIRS, _best_of, _matches, _six, near_pairs
from lexiloom.plans.registry import Tables, query
from lexiloom.session import durable


def _checks(t: Tables) -> dict[str, DataFrame]:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return {
        "line-duplicate": validate.duplicates(lines, "line-duplicate", "l_orderkey", "l_linenumber"),
        "line-order": validate.missing_from(lines, "line-order", "l_orderkey", orders, "o_orderkey"),
        "line-part": validate.missing_from(lines, "line-part", "l_partkey", t.part, "p_partkey"),
        "order-customer": validate.missing_from(orders, "order-customer", "o_custkey", t.customer, "c_custkey"),
        "order-unused": validate.missing_from(orders, "order-unused", "o_orderkey", lines, "l_orderkey"),
        "short-text": validate.rows_where(t.documents, "short-text", F.length("text") < 200, "doc_id", "short"),
        "type-conflict": validate.conflicts(t.part, "type-conflict", "p_type", "p_brand"),
        "both-sides": validate.in_both(t.supplier.select(F.col("s_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k")), "both-sides", "k"),
        "discount-range": validate.rows_where(lines, "discount-range", ~F.col("l_discount").between(0.0, 0.1), "l_orderkey", "out of range"),
    }


@query(
    """
    SELECT 'line-duplicate' AS rule, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'line-order', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'line-part', count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'order-customer', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'order-unused', count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'short-text', count(*) FROM documents WHERE length(text) < 200
    UNION ALL SELECT 'type-conflict', count(*) FROM (SELECT 1 FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1)
    UNION ALL SELECT 'both-sides', count(*) FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer)
    UNION ALL SELECT 'discount-range', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0.0 AND 0.1
    """
)
def validate_summary(t: Tables) -> DataFrame:
    return validate.summary(_checks(t))


@query(
    """
    WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS b, o_orderstatus AS s FROM orders)
    SELECT 'needs-price' AS rule, CAST(k AS VARCHAR) AS subject, 'missing ' || concat_ws(',', CASE WHEN a IS NULL THEN 'a' END, CASE WHEN b IS NULL THEN 'b' END) AS message FROM r WHERE s = 'F' AND (a IS NULL OR b IS NULL)
    UNION ALL SELECT 'one-of', CAST(k AS VARCHAR), ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) || ' of a,b' FROM r WHERE (a IS NULL) = (b IS NULL)
    """
)
def conditional_rules(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey")).alias("b"), "o_orderstatus"
    )
    found = validate.required_if(rows, "needs-price", "k", F.col("o_orderstatus") == "F", "a", "b").union(validate.exactly_one(rows, "one-of", "k", "a", "b"))
    return found.select("rule", "subject", "message")


_MAP = """
    m AS (SELECT 'P' || p_partkey AS subject_id, CASE WHEN p_partkey % 17 = 0 THEN 'x' ELSE p_name END AS subject_label,
                 CASE p_size % 5 WHEN 0 THEN 'skos:exactMatch' WHEN 1 THEN 'skos:relatedMatch' WHEN 2 THEN 'other:match' ELSE 'vocab:has_element_type' END AS predicate_id,
                 CASE WHEN p_size % 10 = 3 THEN 'sssom:NoTermFound' ELSE 'B:' || p_brand END AS object_id, p_brand || CASE WHEN p_partkey % 19 = 0 THEN '?' ELSE '' END AS object_label,
                 CASE p_size % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'not_applicable' WHEN 2 THEN NULL ELSE 'odd' END AS fit,
                 CASE WHEN p_partkey % 13 = 0 THEN 'Not' WHEN p_partkey % 29 = 0 THEN 'Maybe' END AS predicate_modifier FROM part),
    l AS (SELECT 'P' || p_partkey AS subject_id, p_name AS subject_label FROM part WHERE p_partkey % 11 <> 0),
    o AS (SELECT DISTINCT 'B:' || p_brand AS object_id, p_brand AS object_label FROM part WHERE p_brand NOT LIKE '%3'),
    k AS (SELECT m.*, coalesce(predicate_modifier, '') AS mo, coalesce(m.fit, '') AS f, l.subject_id AS ls, l.subject_label AS ll, o.object_id AS oo, o.object_label AS ol
          FROM m LEFT JOIN l ON m.subject_id = l.subject_id LEFT JOIN o ON m.object_id = o.object_id)"""


@query(
    f"""
    WITH {_MAP}
    SELECT 'subject-live' AS rule, count(*) AS n FROM k WHERE ls IS NULL UNION ALL SELECT 'subject-label', count(*) FROM k WHERE ll <> subject_label
    UNION ALL SELECT 'modifier', count(*) FROM k WHERE mo NOT IN ('', 'Not')
    UNION ALL SELECT 'duplicate', count(*) FROM (SELECT 1 FROM k GROUP BY subject_id, predicate_id, object_id, mo HAVING count(*) > 1)
    UNION ALL SELECT 'predicate', count(*) FROM k WHERE predicate_id = 'other:match'
    UNION ALL SELECT 'none-found', count(*) FROM k WHERE object_id = 'sssom:NoTermFound' AND NOT (predicate_id = 'vocab:has_element_type' AND f = 'not_applicable')
    UNION ALL SELECT 'object-live', count(*) FROM k WHERE object_id <> 'sssom:NoTermFound' AND oo IS NULL UNION ALL SELECT 'object-label', count(*) FROM k WHERE ol <> object_label
    UNION ALL SELECT 'banned', count(*) FROM k WHERE predicate_id = 'skos:exactMatch' AND object_id <> 'B:Brand#11'
    UNION ALL SELECT 'fit', count(*) FROM k WHERE predicate_id = 'vocab:has_element_type' AND mo <> 'Not' AND f NOT IN ('exact', 'broad', 'approximate', 'not_applicable')
    UNION ALL SELECT 'fit-negated', count(*) FROM k WHERE mo = 'Not' AND f <> '' UNION ALL SELECT 'fit-elsewhere', count(*) FROM k WHERE predicate_id <> 'vocab:has_element_type' AND f <> ''
    UNION ALL SELECT 'fit-conflict', count(*) FROM (SELECT 1 FROM k WHERE predicate_id = 'vocab:has_element_type' AND mo <> 'Not' GROUP BY subject_id HAVING count(DISTINCT fit) > 1)
    UNION ALL SELECT 'member-and-related', count(*) FROM (SELECT subject_id FROM k WHERE predicate_id = 'vocab:has_element_type' AND mo <> 'Not' AND object_id <> 'sssom:NoTermFound' INTERSECT SELECT subject_id FROM k WHERE predicate_id = 'skos:relatedMatch' AND mo <> 'Not')
    """
)
def mapping_validation(t: Tables) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    subject = F.concat(F.lit("P"), key.cast("string")).alias("subject_id")
    rows = t.part.select(
        subject,
        F.when(key % 17 == 0, "x").otherwise(F.col("p_name")).alias("subject_label"),
        F.when(size % 5 == 0, "skos:exactMatch").when(size % 5 == 1, "skos:relatedMatch").when(size % 5 == 2, "other:match").otherwise("vocab:has_element_type").alias("predicate_id"),
        F.when(size % 10 == 3, validate.NONE_FOUND).otherwise(F.concat(F.lit("B:"), "p_brand")).alias("object_id"),
        F.concat("p_brand", F.when(key % 19 == 0, "?").otherwise("")).alias("object_label"),
        F.when(size % 4 == 0, "exact").when(size % 4 == 1, "not_applicable").when(size % 4 == 3, "odd").alias("fit"),
        F.when(key % 13 == 0, "Not").when(key % 29 == 0, "Maybe").alias("predicate_modifier"),
    )
    live = t.part.where(key % 11 != 0).select(subject, F.col("p_name").alias("subject_label"))
    objects = t.part.where("p_brand not like '%3'").select(F.concat(F.lit("B:"), "p_brand").alias("object_id"), F.col("p_brand").alias("object_label")).distinct()
    policy = validate.MappingPolicy(banned=("skos:exactMatch",), licensed=("B:Brand#11",))
    return validate.counted(validate.mapping_violations(rows, live, objects, policy), validate.MAPPING_RULES)


@query(
    """
    SELECT 'reconcile-left' AS rule, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)
    UNION ALL SELECT 'reconcile-right', count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0 EXCEPT SELECT o_custkey FROM orders)
    """
)
def ledger_reconciliation(t: Tables) -> DataFrame:
    a, b = t.orders.select(F.col("o_custkey").alias("k")), t.customer.where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("k"))
    counts = validate.reconcile(a, b, "reconcile", "k").groupBy("rule").agg(F.count("*").alias("n"))
    rules = t.spark.createDataFrame([("reconcile-left",), ("reconcile-right",)], "rule string")
    return rules.join(counts, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    """
    WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS v FROM customer), b AS (SELECT c_nationkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 50 <> 0 UNION ALL SELECT 99, 'NEW')
    SELECT *, '+' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, '-' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    """
)
def stale_rows(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v"))
    b = t.customer.where("c_custkey % 50 <> 0").select(F.col("c_nationkey"), "c_mktsegment").union(t.spark.createDataFrame([(99, "NEW")], "k int, v string"))
    return validate.stale(b.toDF("k", "v"), a)


@query(
    """
    WITH v(verdict, req, opt) AS (VALUES ('1-URGENT', ['description'], []::VARCHAR[]), ('2-HIGH', ['into'], ['comment']), ('3-MEDIUM', []::VARCHAR[], ['note'])),
    d AS (SELECT o_orderkey AS id, o_orderpriority AS verdict, list_filter(['description', CASE WHEN o_orderkey % 2 = 0 THEN 'into' END, CASE WHEN o_orderkey % 7 = 0 THEN 'comment' END], lambda x: x IS NOT NULL) AS given FROM orders),
    j AS (SELECT d.id, d.verdict, req, list_sort(list_filter(req, lambda x: NOT list_contains(given, x))) AS lacking, list_sort(list_filter(given, lambda x: NOT list_contains(req, x) AND NOT list_contains(opt, x))) AS extra FROM d LEFT JOIN v ON d.verdict = v.verdict)
    SELECT id, verdict, CASE WHEN req IS NULL THEN 'unknown verdict' WHEN len(lacking) > 0 THEN 'missing ' || array_to_string(lacking, ',') ELSE 'unknown field ' || array_to_string(extra, ',') END AS error
    FROM j WHERE req IS NULL OR len(lacking) > 0 OR len(extra) > 0
    """
)
def operation_validation(t: Tables) -> DataFrame:
    verdicts = t.spark.createDataFrame(
        [("term", "1-URGENT", ["description"], []), ("term", "2-HIGH", ["into"], ["comment"]), ("term", "3-MEDIUM", [], ["note"])],
        "kind string, verdict string, required array<string>, optional array<string>",
    )
    key = F.col("o_orderkey")
    given = F.array_compact(F.array(F.lit("description"), F.when(key % 2 == 0, F.lit("into")), F.when(key % 7 == 0, F.lit("comment"))))
    rows = t.orders.select(key.alias("id"), F.lit("term").alias("kind"), F.col("o_orderpriority").alias("verdict"), given.alias("given"))
    return validate.operation_errors(rows, verdicts).select("id", "verdict", "error")


@query(
    f"""
    WITH {_BEST}, p AS ({_PAIRS})
    SELECT 'sim:' || substr(sha1(least('t' || id1, 't' || id2) || '|' || greatest('t' || id1, 't' || id2)), 1, 12) AS id, 'similar-terms' AS rule, 'warn' AS severity, 't' || id1 AS subject1, 't' || id2 AS subject2,
           printf('similar to t%d (%.3f)', id2, similarity) AS message FROM p
    UNION ALL SELECT 'gap:' || substr(sha1('t' || query_id), 1, 12), 'coverage-gap', 'info', 't' || query_id, NULL, printf('best match %.3f', max_similarity) FROM b WHERE max_similarity < 0.3
    UNION ALL SELECT 'map:' || substr(sha1('t' || query_id || '|o' || target_id), 1, 12), 'mapping-suggestion', 'info', 't' || query_id, NULL, printf('maps to o%d (%.3f)', target_id, round(score, 6)) FROM m
    """
)
def findings_normalize(t: Tables) -> DataFrame:
    name = lambda c, p="t": F.concat(F.lit(p), F.col(c).cast("string"))
    pairs = _six(near_pairs(t)).select(name("id1").alias("id1"), name("id2").alias("id2"), "similarity")
    matches = durable(_matches(t), "matches")
    gaps = _best_of(t, matches).where("max_similarity < 0.3").select(name("query_id").alias("id"), "max_similarity")
    maps = _six(matches).select(name("query_id").alias("id"), name("target_id", "o").alias("object"), "similarity")
    return curation.findings(pairs, gaps, maps)


def _found(t: Tables) -> DataFrame:
    """A finding for each order, about its customer and the customers of its lines' suppliers."""
    about = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("also"))
    rows = t.orders.join(about, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    subjects = F.array_distinct(F.concat(F.array("o_custkey"), F.coalesce("also", F.array().cast("array<bigint>"))))
    severity = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warn").otherwise("info")
    return rows.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 23 != 0, subjects).otherwise(F.array().cast("array<bigint>")).alias("subjects"), severity.alias("severity"), F.col("o_orderpriority").alias("source"))


_FOUND = """
    each AS (SELECT DISTINCT id, node FROM (SELECT o_orderkey AS id, o_custkey AS node FROM orders UNION ALL SELECT o_orderkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE id % 23 <> 0),
    f AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warn' ELSE 'info' END AS severity, o_orderpriority AS source FROM orders)"""


@query(
    f"""
    WITH {_FOUND}, al AS (SELECT c_custkey AS node, c_custkey + 1 AS chain_end FROM customer WHERE c_custkey % 6 = 0), lv AS (SELECT c_custkey AS sid FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey % 31 <> 0),
    ok AS (SELECT id FROM each LEFT JOIN al ON each.node = al.node GROUP BY id HAVING bool_and(coalesce(chain_end, each.node) IN (SELECT sid FROM lv)))
    SELECT severity, count(*) AS kept FROM f WHERE id IN (SELECT id FROM ok) GROUP BY severity
    """
)
def finding_liveness(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    aliases = t.customer.where(key % 6 == 0).select(key.alias("node"), (key + 1).alias("chain_end"))
    live = t.customer.where((key % 6 != 0) & (key % 31 != 0)).select(key.alias("sid"))
    return curation.living(_found(t), aliases, live).groupBy("severity").agg(F.count("*").alias("kept"))


@query(
    f"""
    WITH {_FOUND}
    SELECT node AS subject, count(*) AS findings, CAST(sum(CASE severity WHEN 'error' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) AS BIGINT) AS points FROM each JOIN f ON each.id = f.id GROUP BY node
    """
)
def findings_by_subject(t: Tables) -> DataFrame:
    return curation.by_subject(_found(t))


@query(
    f"""
    WITH {_FOUND}, d AS (SELECT c_custkey AS subject, c_custkey * 3 AS cites FROM customer WHERE c_custkey % 8 = 0 AND c_custkey % 5 <> 0)
    SELECT source, count(*) AS open FROM f WHERE id NOT IN (SELECT cites FROM d) AND id NOT IN (SELECT id FROM each WHERE node IN (SELECT subject FROM d)) GROUP BY source
    """
)
def undecided_findings(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    decisions = t.customer.where(key % 8 == 0).select(key.alias("id"), key.alias("subject"), F.when(key % 5 == 0, "withdrawn").otherwise("applied").alias("status"), F.array(key * 3).alias("evidence"))
    return curation.undecided(_found(t), decisions).groupBy("source").agg(F.count("*").alias("open"))


@query(
    """
    SELECT source, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT o_orderpriority AS source, o_orderpriority NOT LIKE '%HIGH' AS fresh FROM orders) GROUP BY source HAVING bool_or(fresh)
    """
)
def fresh_findings(t: Tables) -> DataFrame:
    reports = t.orders.select(F.col("o_orderpriority").alias("source")).distinct().withColumn("fingerprint", F.when(F.col("source").endswith("HIGH"), "old").otherwise("new"))
    return curation.fresh_findings(_found(t).select("id", "source"), reports, "new").groupBy("source").agg(F.count("*").alias("n"))


def _decisions(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("id"), F.col("o_custkey").alias("subject"), F.when(key % 4 == 0, "withdrawn").when(key % 3 == 0, "applied").otherwise("pending").alias("status"),
        (key % 5 != 0).alias("terminal"), F.when(key % 7 == 0, "old").otherwise("now").alias("hash"),
    )


_STATES = """
    s AS (SELECT c_custkey AS subject, c_mktsegment AS layer FROM customer),
    d AS (SELECT * FROM (SELECT o_orderkey AS id, o_custkey AS subject, CASE WHEN o_orderkey % 4 = 0 THEN 'withdrawn' WHEN o_orderkey % 3 = 0 THEN 'applied' ELSE 'pending' END AS status,
                                o_orderkey % 5 <> 0 AS terminal, o_orderkey % 7 = 0 AS old FROM orders WHERE o_custkey % 3 <> 0) WHERE status <> 'withdrawn' QUALIFY row_number() OVER (PARTITION BY subject ORDER BY id DESC) = 1),
    st AS (SELECT s.subject, layer, CASE WHEN status IS NULL AND s.subject % 2 = 0 THEN 'open' WHEN status IS NULL THEN 'unreviewed' WHEN NOT terminal THEN 'deferred' WHEN old THEN 'stale' WHEN status = 'applied' THEN 'applied' ELSE 'settled' END AS state
           FROM s LEFT JOIN d ON s.subject = d.subject)"""


def _states(t: Tables) -> DataFrame:
    subjects = t.customer.select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("layer"), F.lit("now").alias("hash"))
    return curation.states(subjects, _decisions(t).where("subject % 3 <> 0"), t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject")))


@query(f"WITH {_STATES} SELECT subject, layer, state FROM st")
def subject_states(t: Tables) -> DataFrame:
    return _states(t)


@query(f"WITH {_STATES} SELECT layer, state, count(*) AS n FROM st GROUP BY ROLLUP (layer, state)")
def status_rollup(t: Tables) -> DataFrame:
    return curation.state_rollup(_states(t), "layer", "state")


@query(
    f"""
    WITH {_STATES} SELECT layer, count(*) AS total, count(*) FILTER (state IN ('applied', 'settled')) AS settled, round(1000.0 * count(*) FILTER (state IN ('applied', 'settled')) / count(*)) / 10 AS percent FROM st GROUP BY layer
    """
)
def percent_settled(t: Tables) -> DataFrame:
    return curation.percent_settled(_states(t), "layer")


@query(
    """
    WITH u AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), q AS (SELECT p_partkey AS subject, coalesce(n, 0) AS points, p_size, p_retailprice FROM part LEFT JOIN u ON p_partkey = l_partkey)
    SELECT subject, round(0.5 * least(10.0, points) + 2.0 * (p_size / 50.0) + 0.5 * (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) + 0.5 * (CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END)
                          + 3.0 * (CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) + 2.0 * (CASE WHEN subject % 5 = 0 THEN 1 ELSE 0 END) + 3.0 * (CASE WHEN subject % 11 = 0 THEN 1 ELSE 0 END)
                          + 1.0 * (CASE WHEN subject % 13 = 0 THEN 1 ELSE 0 END), 6) AS score FROM q
    """
)
def queue_score(t: Tables) -> DataFrame:
    uses = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("points"))
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = t.part.join(uses, key == F.col("l_partkey"), "left").select(
        key.alias("subject"), "points", (size / 50.0).alias("impact"), (size % 2 == 0).alias("adoption"), (size % 3 == 0).alias("required"),
        (size % 7 == 0).alias("port"), (key % 5 == 0).alias("upstream"), (key % 11 == 0).alias("stale"), (key % 13 == 0).alias("machine"),
    )
    return curation.queue(rows).select("subject", "score")


_SQUEEZE = "trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'))"


@query(
    f"""
    WITH n AS (SELECT doc_id, text, {_SQUEEZE} AS d FROM documents WHERE trim(text) <> ''),
    p AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) AS q FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS x FROM documents WHERE trim(text) <> '')),
    r AS (
      SELECT 'enum-value-no-description' AS rule, doc_id FROM documents WHERE trim(text) = ''
      UNION ALL SELECT 'terse-description', doc_id FROM n WHERE length(trim(text)) < 40
      UNION ALL SELECT 'duplicate-description', doc_id FROM n WHERE d IN (SELECT d FROM n GROUP BY d HAVING count(*) > 1)
      UNION ALL SELECT DISTINCT 'duplicate-paragraph', doc_id FROM p WHERE q <> '' AND q IN (SELECT q FROM p GROUP BY q HAVING count(*) > 1)
      UNION ALL SELECT 'todo-marker', doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bTODO\\b|\\bplaceholder\\b|\\bfor now\\b|\\bplanned\\b.*\\bdeferred\\b'))
    SELECT rule, CAST(doc_id AS VARCHAR) AS subject, CASE rule WHEN 'duplicate-paragraph' THEN 'info' ELSE 'warn' END AS severity FROM r
    """
)
def description_lint(t: Tables) -> DataFrame:
    return curation.description_lint(t.documents.select(F.col("doc_id").alias("subject"), F.col("text").alias("description"))).select("rule", "subject", "severity")


@query(
    """
    WITH u AS (SELECT l_partkey AS subject, CAST(count(*) FILTER (l_quantity > 45) * 20 AS BIGINT) AS files FROM lineitem GROUP BY 1), p AS (SELECT p_partkey AS subject, coalesce(files, 0) AS files FROM part LEFT JOIN u ON p_partkey = subject),
    m AS (SELECT p_partkey AS subject, CASE WHEN p_size % 5 = 0 THEN 'Not' ELSE '' END AS modifier, CASE WHEN p_size % 11 = 0 THEN 'https://x' ELSE 'B:1' END AS object, p_size % 3 = 0 AS decided FROM part WHERE p_brand <> 'Brand#11')
    SELECT 'zero-usage-term' AS rule, count(*) AS n FROM p WHERE files = 0 UNION ALL SELECT 'unmapped-high-usage', count(*) FROM p WHERE files >= 100 AND subject NOT IN (SELECT subject FROM m WHERE modifier <> 'Not')
    UNION ALL SELECT 'no-mapping-at-all', count(*) FROM p WHERE subject NOT IN (SELECT subject FROM m) UNION ALL SELECT 'unreviewed-mapping', count(DISTINCT subject) FROM m WHERE NOT decided
    UNION ALL SELECT 'mapping-target-is-doc-link', count(DISTINCT subject) FROM m WHERE object LIKE 'https://%'
    """
)
def usage_lint(t: Tables) -> DataFrame:
    uses = t.lineitem.groupBy(F.col("l_partkey").alias("subject")).agg((F.count_if(F.col("l_quantity") > 45) * 20).alias("files"))
    size = F.col("p_size")
    maps = t.part.where("p_brand <> 'Brand#11'").select(F.col("p_partkey").alias("subject"), F.when(size % 5 == 0, "Not").otherwise("").alias("modifier"), F.when(size % 11 == 0, "https://x").otherwise("B:1").alias("object"), (size % 3 == 0).alias("decided"))
    return curation.usage_lint(t.part.select(F.col("p_partkey").alias("subject")), uses, maps).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """
    WITH s AS (SELECT p_type AS subset, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1)
    SELECT 'singleton-subset' AS rule, subset AS subject FROM s WHERE n = 1 UNION ALL SELECT 'oversized-subset', subset FROM s WHERE n > 25
    """
)
def subset_lint(t: Tables) -> DataFrame:
    return curation.subset_lint(t.part.select(F.col("p_type").alias("subset"), F.col("p_partkey").alias("subject"))).select("rule", "subject")


@query(
    """
    WITH v AS (SELECT DISTINCT 'brand' AS axis, p_brand AS value FROM part UNION SELECT DISTINCT 'type', p_type FROM part), u AS (SELECT 'brand' AS axis, p_brand AS value FROM part WHERE p_size > 48 UNION ALL SELECT 'type', p_type FROM part WHERE p_size = 7 AND p_partkey % 2 = 0)
    SELECT axis, value FROM v ANTI JOIN u USING (axis, value)
    """
)
def orphan_facet_values(t: Tables) -> DataFrame:
    axis = lambda name, c, rows: rows.select(F.lit(name).alias("axis"), F.col(c).alias("value"))
    values = axis("brand", "p_brand", t.part).union(axis("type", "p_type", t.part)).distinct()
    used = axis("brand", "p_brand", t.part.where("p_size > 48")).union(axis("type", "p_type", t.part.where("p_size = 7 and p_partkey % 2 = 0")))
    return curation.orphan_values(values, used)


@query(
    """
    WITH l AS (SELECT p_partkey AS subject, CASE p_size % 4 WHEN 0 THEN 'Predicted ' WHEN 1 THEN 'male-' WHEN 2 THEN 'unfiltered ' ELSE 'remale ' END || p_name AS label FROM part WHERE p_partkey % 6 <> 0)
    SELECT subject, CASE WHEN label LIKE 'Predicted%' THEN 'predicted' WHEN label LIKE 'male-%' THEN 'male' ELSE 'unfiltered' END AS words FROM l WHERE label NOT LIKE 'remale%'
    """
)
def residual_compounds(t: Tables) -> DataFrame:
    size = F.col("p_size")
    label = F.concat(F.when(size % 4 == 0, "Predicted ").when(size % 4 == 1, "male-").when(size % 4 == 2, "unfiltered ").otherwise("remale "), "p_name")
    terms = t.part.select(F.col("p_partkey").alias("subject"), label.alias("label"))
    kept = t.part.where("p_partkey % 6 = 0").select(F.col("p_partkey").alias("subject"))
    return curation.residual_compounds(terms, curation.FACET_WORDS, kept).select("subject", "words")


@query(
    """
    WITH n AS (SELECT p_partkey AS subject, p_name || ' of ' || p_type || ', ' || p_brand AS label, p_partkey % 6 = 0 AS kept, ' ' || trim(regexp_replace(lower(p_name || ' of ' || p_type || ', ' || p_brand), '[^a-z0-9]+', ' ', 'g')) || ' ' AS said FROM part),
    v AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE 'of ' || p_type END AS value FROM part WHERE p_size > 20 UNION SELECT DISTINCT p_brand FROM part WHERE p_size = 7 UNION SELECT unnest(['male', 'of', '--']))
    SELECT subject, string_agg(DISTINCT value, '|' ORDER BY value) AS words FROM n JOIN v ON contains(said, ' ' || trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) || ' ') AND value <> '--' WHERE NOT kept GROUP BY subject
    """
)
def facet_compounds(t: Tables) -> DataFrame:
    """Labels of several words that hold values of one to three words, of which there are as many as parts have names."""
    size = F.col("p_size")
    terms = t.part.select(F.col("p_partkey").alias("subject"), F.concat("p_name", F.lit(" of "), "p_type", F.lit(", "), "p_brand").alias("label"))
    values = t.part.where(size > 20).select(F.when(size % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("of "), "p_type")).alias("value")).union(t.part.where(size == 7).select("p_brand"))
    kept = t.part.where("p_partkey % 6 = 0").select(F.col("p_partkey").alias("subject"))
    return curation.residual_compounds(terms, ("male", "of", "--"), kept, values).select("subject", "words")


@query(
    """
    SELECT trim(regexp_replace(p_type || '  why', '\\s+', ' ', 'g')) AS reason, min(p_partkey) AS first_ord, string_agg(p_name, ',' ORDER BY p_partkey, p_name) AS terms, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids,
           (SELECT string_agg(b, ',' ORDER BY b) FROM (SELECT DISTINCT p_brand AS b FROM part x WHERE x.p_type = part.p_type AND x.p_size % 5 <> 0)) AS enums
    FROM part WHERE p_size % 5 <> 0 GROUP BY p_type
    """
)
def group_by_rationale(t: Tables) -> DataFrame:
    rows = t.part.select(
        F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("enum"),
        F.concat("p_type", F.lit("  why")).alias("rationale"), F.when(F.col("p_size") % 5 == 0, "withdrawn").otherwise("applied").alias("status"),
    )
    return curation.group_by_rationale(rows)


@query(
    """
    SELECT o_orderkey AS id, 20 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT LIKE '5%'
    """
)
def sequential_numbering(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "applied").otherwise("pending").alias("status"), F.col("o_orderdate").alias("applied_on"),
        F.when(F.col("o_orderpriority").startswith("5"), "seed").otherwise("review").alias("origin"), F.lit("src").alias("writes"),
    )
    return curation.numbered(rows).select("id", F.col("number").cast("long").alias("number"))


@query("SELECT o_custkey AS subject, max(o_orderkey) AS id FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1")
def latest_per_key(t: Tables) -> DataFrame:
    return curation.latest_decisions(_decisions(t)).select("subject", "id")


@query(
    """
    SELECT p_type, p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_size, p_partkey) = 1
    """
)
def keep_first(t: Tables) -> DataFrame:
    return resolve.first_rows(t.part, ["p_type", "p_brand"], "p_size", "p_partkey").select("p_type", "p_name", "p_partkey")


@query(
    """
    WITH p AS (SELECT p_partkey AS subject, CASE WHEN p_size % 2 = 0 THEN 'term' ELSE 'enum' END AS kind, p_size % 3 AS layer, p_size % 5 = 0 AS s1, p_size % 7 = 0 AS s2 FROM part)
    SELECT subject, 'a' AS prompt FROM p WHERE kind = 'term' AND layer IN (0, 1) UNION ALL SELECT subject, 'b' FROM p WHERE s1 OR s2 UNION ALL SELECT subject, 'c' FROM p WHERE kind IN ('enum', 'term') AND layer = 2 AND s2 UNION ALL SELECT subject, 'd' FROM p
    """
)
def prompt_match(t: Tables) -> DataFrame:
    prompts = t.spark.createDataFrame(
        [("a", ["term"], [0, 1], None), ("b", None, None, ["s1", "s2"]), ("c", ["enum", "term"], [2], ["s2"]), ("d", None, None, None)],
        "prompt string, kinds array<string>, layers array<int>, signals array<string>",
    )
    size = F.col("p_size")
    signals = F.array_compact(F.array(F.when(size % 5 == 0, F.lit("s1")), F.when(size % 7 == 0, F.lit("s2"))))
    return curation.matching_prompts(t.part.select(F.col("p_partkey").alias("subject"), F.when(size % 2 == 0, "term").otherwise("enum").alias("kind"), (size % 3).cast("int").alias("layer"), signals.alias("signals")), prompts)


@query(
    """
    WITH c AS (SELECT c_custkey AS k FROM customer), s AS (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT user_id FROM events)
    SELECT 'customers' AS side, k FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'others', k FROM (SELECT k FROM s EXCEPT SELECT k FROM c)
    UNION ALL SELECT 'both', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'either', k FROM (SELECT k FROM c UNION SELECT k FROM s)
    """
)
def set_ops(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("k"))
    s = t.supplier.select(F.col("s_suppkey").alias("k")).union(t.events.select("user_id"))
    named = lambda name, df: df.select(F.lit(name).alias("side"), "k")
    return named("customers", c.subtract(s)).union(named("others", s.subtract(c))).union(named("both", c.intersect(s))).union(named("either", c.union(s).distinct()))


@query(
    """
    SELECT n_regionkey AS layer, count(*) AS classes, string_agg(n_name, '|' ORDER BY n_name) AS names, CAST(min(n_nationkey) AS BIGINT) AS first_id, CAST(max(n_nationkey) AS BIGINT) AS last_id FROM nation GROUP BY 1
    """
)
def current_state(t: Tables) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    return t.nation.groupBy(F.col("n_regionkey").alias("layer")).agg(
        F.count("*").alias("classes"), F.array_join(F.array_sort(F.collect_list("n_name")), "|").alias("names"), F.min(key).alias("first_id"), F.max(key).alias("last_id")
    )


@query(
    """
    SELECT count(*) AS total, count(DISTINCT p_type) AS types, count(*) FILTER (p_size % 4 <> 0) AS mapped, CAST(round(100.0 * count(*) FILTER (p_size % 4 <> 0) / count(*)) AS BIGINT) AS mapped_percent, count(*) FILTER (p_size % 9 = 0) AS not_applicable FROM part
    """
)
def vocabulary_stats(t: Tables) -> DataFrame:
    return reports.vocabulary_stats(t.part.select(F.col("p_type").alias("category"), (F.col("p_size") % 4 != 0).alias("mapped"), (F.col("p_size") % 9 == 0).alias("not_applicable")))


@query(
    """
    WITH e AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT 'total' AS what, CAST(sum(n) AS BIGINT) AS n FROM e UNION ALL SELECT 'types', count(*) FROM e UNION ALL SELECT 'no customer', count(*) FROM u WHERE user_id NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'customers without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
    """
)
def frequency_totals(t: Tables) -> DataFrame:
    users = t.events.groupBy(F.col("user_id").alias("label")).agg(F.count("*").alias("n"))
    found = reports.frequency_totals(users, t.customer.select(F.col("c_custkey").alias("label"))).where("what <> 'labels'")
    types = t.events.agg(F.count_distinct("event_type").alias("n")).select(F.lit("types").alias("what"), "n")
    said = F.when(F.col("what") == "unseeded", "no customer").when(F.col("what") == "unused", "customers without").otherwise(F.col("what"))
    return found.select(said.alias("what"), "n").union(types)


@query(
    """
    SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 25
    """
)
def top_counts(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_brand", "p_type").limit(25)


@query(
    """
    WITH g AS (SELECT p_partkey AS subject, p_name AS label, p_type AS base, p_brand AS value FROM part WHERE p_partkey % 10 = 0),
    a AS (SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT subject FROM g))
    SELECT 'terms' AS what, n FROM a UNION ALL SELECT 'decompositions', count(*) FROM g UNION ALL SELECT 'faceted', count(*) FROM g UNION ALL SELECT 'merged', count(*) FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT 'relabelled', count(*) FROM part WHERE p_brand = 'Brand#12'
    """
)
def curation_edits(t: Tables) -> DataFrame:
    terms = t.part.select(F.col("p_partkey").alias("subject"), F.col("p_name").alias("label"))
    ledger = terms.select("subject", F.lit("live").alias("status"))
    operations = t.part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("subject"), F.col("p_name").alias("label"), F.col("p_type").alias("base"), F.lit("brand").alias("axis"), F.col("p_brand").alias("value"))
    empty = operations.limit(0).select(F.col("label").alias("term"), "base", "axis", "value")
    left, rows, done = curation.apply_facet(terms, empty, ledger, operations)
    merges = t.part.where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("subject"), (F.col("p_partkey") - 1).alias("into"))
    merged = curation.retired(ledger.withColumn("replaced_by", F.lit(None).cast("long")), merges)
    renames = t.spark.createDataFrame([("Brand#12", "Brand#99")], "old string, new string")
    named = curation.relabel(t.part, "p_brand", renames)
    count = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return (
        count("terms", left).union(count("decompositions", rows)).union(count("faceted", done.where("status = 'faceted'"))).union(count("merged", merged.where("status = 'merged' and replaced_by is not null"))).union(count("relabelled", named.where("p_brand = 'Brand#99'")))
    )


