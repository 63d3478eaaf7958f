"""Paths, mappings, slots, rules, reviews and rollups that pages show, over parts, orders, customers, suppliers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.operators import browse, curation, project, reports, resolve, validate
from lexiloom.plans.curate import _FOUND, _found
from lexiloom.plans.registry import Tables, query
from lexiloom.plans.resolve import _RESOLVED, _resolved
from lexiloom.session import in_order
from lexiloom.sources.tables import with_defaults

_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(
    f"""
    WITH f AS (SELECT p_partkey, p_name AS label, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS enum FROM part)
    SELECT p_partkey, 'v:' || replace(label, ' ', '_') || ' ' || 'http://v/' || replace(label, ' ', '_') || CASE WHEN enum IS NULL THEN '' ELSE ' http://v/' || enum || '#' || replace(label, ' ', '%20') END AS forms,
           replace(label, ' ', '\\|') AS cell, CASE WHEN label LIKE '%t' THEN label ELSE label || '.' END AS said
    FROM f
    """
)
def text_forms(t: Tables) -> DataFrame:
    label, enum = F.col("p_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
    cell = text.escaped_pipes(F.replace(label, F.lit(" "), F.lit("|")))
    said = F.when(label.endswith("t"), text.sentence(F.concat(label, F.lit("!")))).otherwise(text.sentence(F.concat(label, F.lit("  "))))
    forms = text.legacy_forms(label, enum, "v", "http://v/")
    return t.part.select("p_partkey", F.array_join(forms, " ").alias("forms"), cell.alias("cell"), F.regexp_replace(said, "!$", "").alias("said"))


@query(
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, CAST(round_even(value, 0) AS DOUBLE) AS even, props LIKE '%"' || 'k' || '"%' AS holds FROM events
    """
)
def event_stamps(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.iso_time(F.col("ts")).alias("at"), text.half_even(F.col("value"), 0).cast("double").alias("even"), text.holds_quoted(F.col("props"), F.lit("k")).alias("holds"))


@query(
    """
    WITH n AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_name ELSE upper(p_name) END AS name FROM part)
    SELECT name, row_number() OVER (ORDER BY lower(name), CASE WHEN name = lower(name) THEN 0 ELSE 1 END) AS place FROM n
    """
)
def locale_order(t: Tables) -> DataFrame:
    names = t.part.select(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("name")).distinct()
    return in_order(names.withColumn("key", text.locale_key(F.col("name"))), "place", 1, "key").select("name", F.col("place").cast("long").alias("place"))


def _subjects(t: Tables) -> DataFrame:
    """Customers as subjects of all kinds: segments are kinds, nations their enums and classes."""
    key, nation = F.col("c_custkey"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    kind = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "class").when(F.col("c_mktsegment") == "BUILDING", "term").when(F.col("c_mktsegment") == "FURNITURE", "slot").when(F.col("c_mktsegment") == "HOUSEHOLD", "enum").otherwise("usage")
    return t.customer.select(
        key.alias("sid"), kind.alias("kind"), F.when(kind == "usage", F.concat(nation, F.lit("/s"))).otherwise(F.col("c_name")).alias("name"), F.col("c_name").alias("label"),
        nation.alias("enum"), F.when(key % 3 != 0, nation).alias("owner_class"), (F.col("c_acctbal") < 0).alias("retired"), (F.col("c_nationkey") % 4).alias("layer"),
    )


_SUBJECTS = """
    s AS (SELECT c_custkey AS sid, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'class' WHEN 'BUILDING' THEN 'term' WHEN 'FURNITURE' THEN 'slot' WHEN 'HOUSEHOLD' THEN 'enum' ELSE 'usage' END AS kind, c_name AS label,
                 'N' || c_nationkey AS nation, CASE WHEN c_custkey % 3 <> 0 THEN 'N' || c_nationkey END AS owner_class, c_acctbal < 0 AS retired, c_nationkey % 4 AS layer FROM customer)"""


@query(
    f"""
    WITH {_SUBJECTS}
    SELECT sid, CASE WHEN retired THEN NULL WHEN kind = 'class' THEN '/schema/class/' || label WHEN kind = 'enum' THEN '/schema/enum/' || label
                WHEN kind = 'term' AND nation = 'N3' THEN '/threes/' || {_SLUG.format("label")} WHEN kind = 'term' AND nation = 'N4' THEN '/four' WHEN kind = 'term' THEN '/schema/enum/' || nation
                WHEN kind = 'slot' AND owner_class = 'N5' THEN '/five' WHEN kind = 'slot' THEN '/schema/class/' || owner_class WHEN nation = 'N5' THEN '/five' ELSE '/schema/class/' || nation END AS path
    FROM s
    """
)
def browse_paths(t: Tables) -> DataFrame:
    return browse.browse_path(_subjects(t), {"N4": "/four"}, {"N5": "/five"}, {"N3": "/threes"}).select("sid", "path")


@query(
    """
    WITH x AS (SELECT p_name AS term, count(*) AS rows, count(*) FILTER (p_size = 7) AS sevens FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_retailprice < 2000 GROUP BY 1)
    SELECT term, coalesce(CASE WHEN rows % 2 = 0 THEN 'even' END, '') AS note, rows FROM x
    """
)
def content_live(t: Tables) -> DataFrame:
    subjects = t.part.select(F.lit("term").alias("kind"), F.col("p_type").alias("enum"), (F.col("p_retailprice") >= 2000).alias("retired"), F.col("p_name").alias("term"))
    rows = browse.content_terms(subjects, ("PROMO", "SMALL")).groupBy("term").agg(F.count("*").alias("rows"))
    return with_defaults(rows.select("term", F.when(F.col("rows") % 2 == 0, "even").alias("note"), "rows"))


@query(
    """
    WITH t AS (SELECT p_name AS term_id, min(p_size) AS a, max(p_size) AS b, string_agg(DISTINCT 'S:' || p_type, '|' ORDER BY 'S:' || p_type) AS types FROM part GROUP BY 1),
    m AS (SELECT p_name AS term_id, p_partkey AS row_no, 'E:' || p_brand AS object FROM part WHERE p_size % 25 = 0), l AS (SELECT term_id, arg_max(object, row_no) AS object FROM m GROUP BY 1),
    e AS (SELECT p_partkey AS row_no, p_name AS term_id, CASE WHEN p_size % 12 = 0 THEN 'sssom:NoTermFound' ELSE 'S:' || p_type END AS object, lower(p_type) AS label FROM part WHERE p_size > 40),
    k AS (SELECT term_id, string_agg(object, '|' ORDER BY row_no) AS members FROM e WHERE object <> 'sssom:NoTermFound' GROUP BY 1),
    y AS (SELECT t.term_id, string_agg(x.o || '=' || coalesce((SELECT min(label) FROM e WHERE e.term_id = t.term_id AND e.object = x.o), ''), '|' ORDER BY x.o) AS types FROM t, (SELECT term_id AS i, unnest(string_split(types, '|')) AS o FROM t) x WHERE x.i = t.term_id GROUP BY 1)
    SELECT t.term_id, CASE WHEN l.object IS NOT NULL THEN 'rowMatch' WHEN a % 2 = 0 THEN 'closeMatch' WHEN b % 2 = 0 THEN 'relatedMatch' END AS predicate,
           coalesce(l.object, CASE WHEN a % 2 = 0 THEN 'E:' || a WHEN b % 2 = 0 THEN 'E:' || b END) AS object,
           CASE WHEN l.object IS NOT NULL THEN 'row' WHEN a % 2 = 0 OR b % 2 = 0 THEN 'slot' ELSE 'none' END AS source, coalesce(k.members, '') AS members, y.types
    FROM t LEFT JOIN l ON t.term_id = l.term_id LEFT JOIN k ON t.term_id = k.term_id JOIN y ON t.term_id = y.term_id
    """
)
def mapping_enrichment(t: Tables) -> DataFrame:
    size, none = F.col("p_size"), F.array().cast("array<string>")
    low, high = F.min(size), F.max(size)
    types = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("S:"), "p_type"))), " | ")
    slot = lambda n: F.array(F.lit("other:1"), F.concat(F.when(n % 2 == 0, "E:").otherwise("F:"), n.cast("string")))
    terms = t.part.groupBy(F.col("p_name").alias("term_id")).agg(types.alias("element_type"), none.alias("exact"), slot(low).alias("close"), F.lit(None).cast("array<string>").alias("broad"), slot(high).alias("related"))
    mappings = t.part.where("p_size % 25 = 0").select(F.col("p_partkey").alias("row_no"), F.col("p_name").alias("term_id"), F.lit("rowMatch").alias("predicate"), F.concat(F.lit("E:"), "p_brand").alias("object"), F.lit("").alias("object_label"))
    members = t.part.where("p_size > 40").select(F.col("p_partkey").alias("row_no"), F.col("p_name").alias("term_id"), F.when(size % 12 == 0, project.NONE_FOUND).otherwise(F.concat(F.lit("S:"), "p_type")).alias("object"), F.lower("p_type").alias("object_label"))
    return browse.enriched(terms, mappings, members, "E:")


@query(
    """
    WITH g AS (SELECT p_partkey AS id, p_name AS subject, CASE WHEN p_size % 2 = 0 THEN 'http://e/' || p_brand ELSE 'e:' || p_brand END AS object FROM part),
    r AS (SELECT DISTINCT p_name AS subject, 'e:' || p_brand AS object FROM part WHERE p_size > 35)
    SELECT id, g.subject, g.object FROM g SEMI JOIN r ON g.subject = r.subject AND replace(g.object, 'http://e/', 'e:') = r.object
    """
)
def already_mapped(t: Tables) -> DataFrame:
    iri = F.concat(F.lit("http://e/"), "p_brand")
    asked = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("subject"), F.when(F.col("p_size") % 2 == 0, iri).otherwise(F.concat(F.lit("e:"), "p_brand")).alias("object"))
    rows = t.part.where("p_size > 35").select(F.col("p_name").alias("subject"), F.when(F.col("p_size") % 3 == 0, iri).otherwise(F.concat(F.lit("e:"), "p_brand")).alias("object"))
    return browse.already_mapped(asked, rows, "http://e/", "e").select("id", "subject", "object")


@query(
    """
    WITH s AS (SELECT p_type AS class, CASE WHEN p_size % 5 = 0 THEN 'edge_' ELSE 's_' END || p_partkey AS slot, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS range, CASE WHEN p_size % 3 = 0 THEN p_size % 2 = 0 END AS required FROM part),
    v AS (SELECT p_brand AS enum, count(*) AS terms FROM part WHERE p_size > 10 GROUP BY 1)
    SELECT class, slot, CASE WHEN slot LIKE 'edge%' THEN 'edge properties' ELSE 'feature properties' END AS "group", CASE WHEN range = '' THEN 'string' ELSE range END AS range, coalesce(required, false) AS required,
           CASE WHEN slot LIKE '%7' THEN 'Required when x is true.' END AS rule, '/v/' || v.enum AS path, coalesce(v.terms, 0) AS terms FROM s LEFT JOIN v ON s.range = v.enum
    """
)
def slot_links(t: Tables) -> DataFrame:
    size = F.col("p_size")
    slots = t.part.select(
        F.col("p_type").alias("class"), F.concat(F.when(size % 5 == 0, "edge_").otherwise("s_"), F.col("p_partkey").cast("string")).alias("slot"),
        F.when(size % 4 == 0, "").otherwise(F.col("p_brand")).alias("range"), F.when(size % 3 == 0, size % 2 == 0).alias("required"),
    )
    rules = slots.where("slot like '%7'").select("class", "slot", F.lit("Required when x is true.").alias("rule"))
    counts = t.part.where("p_size > 10").groupBy(F.col("p_brand").alias("enum")).agg(F.count("*").alias("terms"))
    out = browse.slot_links(slots, rules, counts.select("enum", F.concat(F.lit("/v/"), "enum").alias("path"), "terms"))
    return out.withColumn("terms", F.coalesce("terms", F.lit(0)))


@query(
    """
    WITH c AS (SELECT o_custkey AS class, o_orderkey AS rule_no, 's' || l_linenumber AS slot, l_linenumber AS ord, l_returnflag AS v,
                      CASE WHEN l_quantity < 15 THEN 'pre' WHEN l_quantity < 20 THEN 'any' WHEN l_quantity < 45 THEN 'post' ELSE 'one' END AS side, CASE l_suppkey % 4 WHEN 0 THEN 'equals' WHEN 1 THEN 'number' WHEN 2 THEN 'presence' END AS test
               FROM orders JOIN (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey),
    x AS (SELECT *, CASE WHEN side = 'any' AND test IS DISTINCT FROM 'equals' THEN slot ELSE CASE test WHEN 'equals' THEN slot || ' = "' || v || '"' WHEN 'number' THEN slot || ' is true' WHEN 'presence' THEN slot || ' is present' ELSE slot END END AS said FROM c),
    g AS (SELECT class, rule_no, string_agg(said, ' and ' ORDER BY ord) FILTER (side = 'pre') AS pre, string_agg(said, ' or ' ORDER BY ord) FILTER (side = 'any') AS alt, string_agg(slot, ', ' ORDER BY ord) FILTER (side = 'post') AS post,
                 string_agg(slot, ' / ' ORDER BY ord) FILTER (side = 'one') AS one, string_agg(slot, ', ' ORDER BY ord) FILTER (side = 'one') AS ones FROM x GROUP BY 1, 2)
    SELECT class, rule_no, 'Exactly one of ' || one || ' is required.' AS summary, ones AS slots FROM g WHERE one IS NOT NULL
    UNION ALL SELECT class, rule_no, 'When ' || concat_ws(' and ', pre, alt) || ': ' || post || ' required.', post FROM g WHERE post IS NOT NULL
    """
)
def rule_summaries(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("value"))
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    n, k = F.col("l_quantity"), F.col("l_suppkey") % 4
    return browse.rule_summaries(
        rows.select(
            F.col("o_custkey").alias("class"), F.col("o_orderkey").alias("rule_no"), F.when(n < 15, "pre").when(n < 20, "any").when(n < 45, "post").otherwise("one").alias("side"), F.col("l_linenumber").alias("ord"),
            F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("slot"), F.when(k == 0, "equals").when(k == 1, "number").when(k == 2, "presence").alias("test"), "value",
        )
    )


@query(
    """
    WITH r AS (SELECT s_suppkey AS request, (s_suppkey * 7) % 150 AS a, (s_suppkey * 11 + 3) % 150 AS b FROM supplier)
    SELECT DISTINCT c_custkey AS subject, request FROM customer JOIN r ON c_custkey = a OR (c_custkey = b AND c_acctbal > 0)
    """
)
def citations(t: Tables) -> DataFrame:
    terms = t.customer.select(F.col("c_custkey").alias("subject"), F.col("c_name").alias("label"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit('T"'), F.col("c_custkey").cast("string"))).alias("term_id"))
    label = F.concat(F.lit("Customer#"), F.lpad(((F.col("s_suppkey") * 7) % 150).cast("string"), 9, "0"))
    number = F.concat(F.lit('T"'), ((F.col("s_suppkey") * 11 + 3) % 150).cast("string"))
    requests = t.supplier.select(F.col("s_suppkey").alias("request"), F.to_json(F.struct(label.alias("label"), F.array(number).alias("terms"), F.concat(F.lit("not "), label).alias("note"))).alias("document"))
    return browse.citations(terms, requests)


@query(
    """
    SELECT 'map:' || substr(sha1(CAST(p_size AS VARCHAR)), 1, 12) AS finding, 'B' || arg_max(p_partkey, (p_retailprice, 'B' || p_partkey)) AS object, arg_max(p_name, (p_retailprice, 'B' || p_partkey)) AS label,
           arg_max(p_type, (p_retailprice, 'B' || p_partkey)) AS source, max(p_retailprice) AS score FROM part GROUP BY p_size
    """
)
def suggestion_map(t: Tables) -> DataFrame:
    rows = t.part.select(
        text.finding_id("map", F.col("p_size").cast("string")).alias("id"), F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("term_id"), F.col("p_name").alias("term_name"), F.col("p_type").alias("ontology"), F.col("p_retailprice").alias("similarity")
    )
    return browse.suggestions(rows)


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14') AND p_size >= 10 AND (p_name LIKE '%bolt%' OR p_brand LIKE '%13')")
def page_filters(t: Tables) -> DataFrame:
    rows = t.part.withColumn("other", F.when(F.col("p_brand").endswith("13"), "BOLTS"))
    return browse.filtered(rows, {"p_type": "PROMO", "p_brand": None}, {"p_brand": ("Brand#11", "Brand#12", "Brand#13", "Brand#14"), "p_name": ()}, (" Bolt ", ("p_name", "other")), {"p_size": 10}).select("p_partkey")


def _ruled(t: Tables) -> DataFrame:
    """Findings of parts: rules by size, some parts without any."""
    size = F.col("p_size")
    names = ("similar-terms", "coverage-gap", "zero-usage-term", "terse-description", "shared-slot", "mapping-suggestion", "no-mapping-at-all", "unmapped-high-usage")
    rules = F.array_compact(F.array(*(F.when(size % (k + 3) == 0, F.lit(n)) for k, n in enumerate(names))))
    rows = t.part.select(F.col("p_partkey").alias("subject"), F.when(size % 2 == 0, "term").when(size % 5 == 0, "slot").when(size % 7 == 0, "other").otherwise("class").alias("kind"), "p_size", F.col("p_name").alias("other"), F.explode_outer(rules).alias("rule"))
    message = F.when(F.col("rule") == "terse-description", F.concat(F.lit("it is "), F.col("p_size").cast("string"), F.lit(" chars"))).when(F.col("rule") == "unmapped-high-usage", F.concat(F.lit("has "), (F.col("p_size") * 1000).cast("string"), F.lit(" files")))
    message = message.when(F.col("rule") == "similar-terms", F.concat(F.lit("similarity "), (F.col("p_size") / 100).cast("decimal(4,2)").cast("string"), F.lit(" to another")))
    return rows.withColumn("message", F.coalesce(message, F.concat(F.lit("of "), "rule")))


_RULED = """
    q AS (SELECT p_partkey AS subject, p_size, p_name, CASE WHEN p_size % 2 = 0 THEN 'term' WHEN p_size % 5 = 0 THEN 'slot' WHEN p_size % 7 = 0 THEN 'other' ELSE 'class' END AS kind FROM part),
    rn AS (SELECT unnest(['similar-terms', 'coverage-gap', 'zero-usage-term', 'terse-description', 'shared-slot', 'mapping-suggestion', 'no-mapping-at-all', 'unmapped-high-usage']) AS rule, unnest(range(3, 11)) AS k),
    f AS (SELECT subject, kind, p_size, p_name, rule FROM q JOIN rn ON p_size % k = 0)"""


@query(
    f"""
    WITH {_RULED},
    ty(track, type, kind, rule) AS (VALUES ('vocabulary', 'links', 'term', 'coverage-gap'), ('vocabulary', 'links', 'term', 'mapping-suggestion'), ('vocabulary', 'links', 'term', 'no-mapping-at-all'), ('vocabulary', 'links', 'term', 'unmapped-high-usage'),
      ('vocabulary', 'duplicates', 'term', 'similar-terms'), ('vocabulary', 'keep-or-cut', 'term', 'zero-usage-term'), ('vocabulary', 'definitions', 'term', 'terse-description'),
      ('schema', 'definitions', 'slot', 'terse-description'), ('schema', 'definitions', 'class', 'terse-description'), ('schema', 'structure', 'slot', 'shared-slot'), ('schema', 'structure', 'class', 'shared-slot')),
    m AS (SELECT DISTINCT f.subject, ty.track, ty.type FROM f JOIN ty ON f.kind = ty.kind AND f.rule = ty.rule)
    SELECT * FROM m UNION ALL SELECT subject, CASE WHEN kind = 'term' THEN 'vocabulary' ELSE 'schema' END, 'signoff' FROM q WHERE kind <> 'other' AND subject NOT IN (SELECT subject FROM m)
    """
)
def review_items(t: Tables) -> DataFrame:
    found = _ruled(t)
    return browse.review_items(found.select("subject", "kind").distinct(), found.where("rule is not null"))


@query(
    f"""
    WITH {_RULED}
    SELECT subject, rule, CASE rule WHEN 'no-mapping-at-all' THEN 'Not linked to any outside ontology.' WHEN 'unmapped-high-usage' THEN 'Used by ' || format('{{:,}}', p_size * 1000) || ' files, but not linked to any outside ontology.'
           WHEN 'coverage-gap' THEN 'The automatic matcher found nothing similar in other ontologies.' WHEN 'zero-usage-term' THEN 'No file uses this term.' WHEN 'terse-description' THEN 'Definition is very short (' || p_size || ' characters).'
           WHEN 'shared-slot' THEN 'Used by more than one class.' WHEN 'similar-terms' THEN 'Reads almost the same as "' || p_name || '" (' || p_size || '% similar).' ELSE 'of ' || rule END AS reason
    FROM f WHERE rule <> 'mapping-suggestion' AND NOT (rule = 'no-mapping-at-all' AND p_size % 10 = 0)
    """
)
def reason_texts(t: Tables) -> DataFrame:
    return browse.reasons(_ruled(t).where("rule is not null").select("subject", "rule", "message", "other"))


@query(
    """
    WITH f AS (SELECT o_orderkey AS id, o_custkey AS sid, CASE WHEN o_orderstatus = 'O' THEN 'schema_lint' ELSE 'embeddings' END AS source FROM orders WHERE o_totalprice > 200000),
    c AS (SELECT sid, count(*) AS findings, count(*) FILTER (source = 'schema_lint') AS lint FROM f GROUP BY 1), l AS (SELECT o_custkey AS sid, max(o_orderkey) AS latest FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT c_custkey AS sid, c_mktsegment AS kind, CASE WHEN c_nationkey % 2 = 0 THEN 'open' ELSE 'unreviewed' END AS state, CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal ELSE 0.0 END AS score, coalesce(findings, 0) AS findings, coalesce(lint, 0) AS lint, CAST(latest AS VARCHAR) AS latest,
           CASE WHEN c_nationkey = 7 THEN 'a|b' WHEN c_nationkey % 5 = 0 THEN 'b' ELSE '' END AS prompts
    FROM customer LEFT JOIN c ON c_custkey = c.sid LEFT JOIN l ON c_custkey = l.sid
    """
)
def subject_index(t: Tables) -> DataFrame:
    sid, nation = F.col("c_custkey").alias("sid"), F.col("c_nationkey")
    states = t.customer.where("c_nationkey % 2 = 0").select(sid, F.lit("open").alias("state"), F.col("c_acctbal").alias("score"))
    found = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("sid"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "schema_lint").otherwise("embeddings").alias("source"))
    latest = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("sid")).agg(F.max("o_orderkey").cast("string").alias("id"))
    prompts = t.customer.select(sid, F.explode(F.when(nation == 7, F.array(F.lit("b"), F.lit("a"))).when(nation % 5 == 0, F.array(F.lit("b")))).alias("prompt"))
    return browse.subject_index(t.customer.select(sid, F.col("c_mktsegment").alias("kind")), states, found, latest, prompts)


@query("SELECT p_partkey AS subject FROM part WHERE p_size % 2 = 0")
def machine_text(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("subject"), F.concat_ws("  ", "p_name", "p_type").alias("description"))
    machine = t.part.select(F.col("p_partkey").alias("subject"), F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name")).alias("text"))
    return browse.machine_definitions(rows, machine)


@query(
    """
    WITH u AS (SELECT l_partkey AS sid, count(*) * 1000 AS files, count(DISTINCT l_orderkey) AS datasets FROM lineitem GROUP BY 1)
    SELECT p_partkey AS sid, format('{:,}', coalesce(files, 0)) || ' files in ' || format('{:,}', coalesce(datasets, 0)) || ' datasets.' AS text, p_name AS seeds FROM part LEFT JOIN u ON p_partkey = sid
    """
)
def usage_panels(t: Tables) -> DataFrame:
    uses = t.lineitem.groupBy(F.col("l_partkey").alias("sid")).agg((F.count("*") * 1000).alias("files"), F.count_distinct("l_orderkey").alias("datasets"))
    return browse.usage_panel(t.part.select(F.col("p_partkey").alias("sid"), F.col("p_name").alias("labels")).join(uses, "sid", "left"))


_CONTAINED = f"""
    {_SUBJECTS},
    x AS (SELECT 'customer:' || sid AS sid, kind, layer, retired, CASE WHEN kind = 'term' THEN 'customer:' || (sid - sid % 10) WHEN kind = 'usage' AND sid % 2 = 0 THEN 'customer:' || (sid - sid % 10) END AS container, owner_class,
                 CASE sid % 6 WHEN 0 THEN 'applied' WHEN 1 THEN 'settled' WHEN 2 THEN 'deferred' WHEN 3 THEN 'open' WHEN 4 THEN 'stale' ELSE 'unreviewed' END AS state FROM s WHERE NOT retired),
    h AS (SELECT *, CASE WHEN kind IN ('term', 'usage') AND container IS NOT NULL THEN container WHEN kind IN ('enum', 'class') THEN sid WHEN kind = 'slot' AND owner_class IS NOT NULL THEN 'class:' || owner_class END AS home FROM x),
    k AS (SELECT h.*, coalesce(home, CASE WHEN h.kind = 'slot' THEN 'shared-slots' ELSE 'other' END || ':' || h.layer) AS key, o.layer AS home_layer FROM h LEFT JOIN x o ON h.home = o.sid),
    g AS (SELECT key, coalesce(max(home_layer), min(layer)) AS at FROM k GROUP BY 1)"""


@query(
    f"""
    WITH {_CONTAINED}
    SELECT CAST(g.at AS VARCHAR) AS layer, k.key, count(*) FILTER (state = 'applied') AS applied, count(*) FILTER (state = 'settled') AS settled, count(*) FILTER (state = 'deferred') AS deferred, count(*) FILTER (state = 'open') AS open,
           count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'unreviewed') AS unreviewed, count(*) AS total, round(1000.0 * count(*) FILTER (state IN ('applied', 'settled')) / count(*)) / 10 AS percent
    FROM k JOIN g ON k.key = g.key GROUP BY ROLLUP (g.at, k.key)
    """
)
def container_rollup(t: Tables) -> DataFrame:
    rows, sid = _subjects(t), F.col("sid")
    name = lambda n: F.concat(F.lit("customer:"), n.cast("string"))
    inside = name(sid - sid % 10)
    container = F.when(F.col("kind") == "term", inside).when((F.col("kind") == "usage") & (sid % 2 == 0), inside)
    state = F.element_at(F.array(*(F.lit(s) for s in ("applied", "settled", "deferred", "open", "stale", "unreviewed"))), (sid % 6 + 1).cast("int"))
    out = curation.container_rollup(rows.select(name(sid).alias("sid"), "kind", "layer", container.alias("container"), "owner_class", state.alias("state"), "retired"))
    return out.withColumn("layer", F.col("layer").cast("string"))


@query(
    f"""
    WITH {_FOUND}, live AS (SELECT c_custkey AS sid FROM customer WHERE c_acctbal >= 0)
    SELECT source, severity AS rule, count(*) AS n FROM f WHERE id IN (SELECT id FROM each WHERE node IN (SELECT sid FROM live)) GROUP BY 1, 2
    """
)
def open_by_rule(t: Tables) -> DataFrame:
    subjects = t.customer.select(F.col("c_custkey").alias("subject"), (F.col("c_acctbal") < 0).alias("retired"))
    return curation.open_by_rule(_found(t).withColumnRenamed("severity", "rule"), subjects)


@query(
    f"""
    WITH {_FOUND}, r AS (SELECT source AS rule, min(CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END) AS o, count(*) AS n FROM f WHERE NOT (source LIKE '5%' AND severity = 'error') GROUP BY 1),
    k AS (SELECT source AS rule, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS kinds FROM f JOIN each ON f.id = each.id JOIN customer ON node = c_custkey WHERE NOT (source LIKE '5%' AND severity = 'error') GROUP BY 1)
    SELECT row_number() OVER (ORDER BY o, r.rule) AS place, r.rule, CASE o WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END AS severity, n, kinds FROM r LEFT JOIN k ON r.rule = k.rule
    """
)
def lint_by_rule(t: Tables) -> DataFrame:
    found = _found(t).withColumnRenamed("source", "rule").where("not (rule like '5%' and severity = 'error')")
    kinds = t.customer.select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("kind"))
    return curation.by_rule(found, kinds).withColumn("place", F.col("place").cast("long"))


@query(
    """
    WITH m AS (SELECT p_name AS subject, p_type AS predicate, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS fit FROM part)
    SELECT 'predicate' AS what, predicate AS name, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'fit', fit, count(*) FROM m WHERE fit <> '' GROUP BY 2 UNION ALL SELECT 'subjects', '', count(DISTINCT subject) FROM m
    """
)
def mapping_counts(t: Tables) -> DataFrame:
    return reports.mapping_counts(t.part.select(F.col("p_name").alias("subject"), F.col("p_type").alias("predicate"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("fit")))


@query(
    """
    SELECT count(*) FILTER (p_type = 'PROMO' AND p_size <> 9) AS members, count(*) FILTER (p_type = 'SMALL') AS related, count(*) FILTER (p_type IN ('LARGE', 'MEDIUM') AND p_brand IN ('Brand#1', 'Brand#2')) AS sets,
           count(*) FILTER (p_type IN ('LARGE', 'MEDIUM') AND p_brand = 'Brand#3') AS attributes FROM part
    """
)
def roundtrip_summary(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_type").alias("predicate"), F.when((F.col("p_type") == "PROMO") & (F.col("p_size") == 9), project.NONE_FOUND).otherwise(F.col("p_brand")).alias("object"))
    return reports.roundtrip_summary(rows, "PROMO", "SMALL", ("LARGE", "MEDIUM"), ("Brand#1", "Brand#2"), ("Brand#3",))


@query(
    """
    SELECT 'new terms' AS what, count(*) AS n FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT 'modifications', count(*) FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'proposed labels', CAST(coalesce(sum(p_size % 4), 0) AS BIGINT) FROM part
    UNION ALL SELECT 'rejection groups', count(*) FROM supplier UNION ALL SELECT 'rejected terms', CAST(coalesce(sum(s_nationkey % 3), 0) AS BIGINT) FROM supplier
    """
)
def request_stats(t: Tables) -> DataFrame:
    size = F.col("p_size")
    requests = t.part.select(F.when(size % 3 == 0, "modification").otherwise("new_term").alias("kind"), (size % 4).alias("labels"))
    return reports.request_stats(requests, t.supplier.select(F.when(F.col("s_nationkey") % 3 != 0, F.array_repeat(F.lit("t"), (F.col("s_nationkey") % 3).cast("int"))).alias("terms")))


@query(
    """
    WITH c AS (SELECT CASE WHEN p_size % 9 = 0 THEN 'uncategorized' ELSE p_brand END AS category, p_partkey, p_name FROM part)
    SELECT category, count(*) AS n, string_agg(p_name, '|' ORDER BY p_partkey) AS listed FROM c GROUP BY 1
    """
)
def terms_by_category(t: Tables) -> DataFrame:
    return reports.terms_by_category(t.part.select(F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("category"), F.col("p_name").alias("name"), F.col("p_partkey").alias("row_no")))


@query(
    f"""
    WITH {_SUBJECTS} SELECT layer AS module, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds, count(*) AS n FROM s WHERE NOT retired AND kind <> 'enum' GROUP BY 1
    """
)
def module_members(t: Tables) -> DataFrame:
    rows = _subjects(t)
    return reports.module_members(rows.select("sid", F.when(F.col("kind") == "enum", "module").otherwise(F.col("kind")).alias("kind"), F.col("layer").alias("module"), "retired"))


@query(
    """
    WITH x AS (SELECT p_type AS enum, p_partkey AS id, p_size % 4 AS maps, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_brand END AS et, p_size = 13 AS retired FROM part)
    SELECT enum, count(*) FILTER (NOT retired) AS total, count(*) FILTER (NOT retired AND maps > 0) AS mapped, count(*) FILTER (NOT retired AND trim(et) <> '') AS annotated, count(*) FILTER (retired) AS retired,
           min(id) FILTER (NOT retired) AS first_id, max(id) FILTER (NOT retired) AS last_id FROM x GROUP BY 1
    """
)
def term_state(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return reports.current_state(t.part.select(F.col("p_type").alias("enum"), F.col("p_partkey").alias("id"), F.array_repeat(F.lit("m"), (size % 4).cast("int")).alias("mappings"), F.when(size % 5 == 0, " ").otherwise(F.col("p_brand")).alias("element_type"), (size == 13).alias("retired")))


@query(
    """
    WITH m AS (SELECT l_partkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN 'member' WHEN l_linenumber % 3 = 1 THEN 'related' ELSE 'exact' END AS predicate, CASE WHEN l_suppkey % 5 = 0 THEN 'none' WHEN l_suppkey % 2 = 0 THEN 'B:' || l_suppkey ELSE 'X:' || l_suppkey END AS object
               FROM lineitem WHERE l_quantity > 40 AND l_returnflag <> 'R'),
    p AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN 'class' ELSE 'term' END AS kind, p_type AS enum, p_size % 4 AS layer, p_size = 13 AS retired FROM part),
    s AS (SELECT p.*, count(m.k) FILTER (NOT retired) AS rows, coalesce(bool_or(predicate = 'member' OR (predicate = 'related' AND object LIKE 'B:%')), false) AS ann, coalesce(bool_or(predicate = 'member' AND object <> 'none'), false) AS cls,
                 count(*) FILTER (NOT retired AND predicate = 'member') AS nm, count(*) FILTER (NOT retired AND predicate = 'related') AS nr
          FROM p LEFT JOIN m ON p.k = m.k GROUP BY ALL),
    g AS (SELECT grouping(kind, e, layer) AS g, kind, e AS enum, layer, count(*) FILTER (NOT retired) AS n, count(*) FILTER (NOT retired AND rows > 0) AS mapped, count(*) FILTER (NOT retired AND ann) AS annotated, count(*) FILTER (NOT retired AND cls) AS with_class,
                 count(*) FILTER (retired) AS retired, min(id) AS first_id, max(id) AS last_id, CAST(sum(rows) AS BIGINT) AS rows
          FROM (SELECT *, CASE WHEN kind = 'term' THEN enum END AS e, CASE WHEN kind = 'term' AND NOT retired THEN k END AS id FROM s) GROUP BY GROUPING SETS ((), (kind), (e), (kind, layer)))
    SELECT CASE g WHEN 7 THEN 'all' WHEN 3 THEN 'kind' WHEN 5 THEN 'enum' ELSE 'layer' END AS level, kind, enum, CAST(layer AS VARCHAR) AS layer, CAST(NULL AS VARCHAR) AS predicate, n, mapped, annotated, with_class, retired, CAST(first_id AS VARCHAR) AS first_id, CAST(last_id AS VARCHAR) AS last_id, rows FROM g WHERE NOT (g = 5 AND enum IS NULL)
    UNION ALL SELECT 'predicate', NULL, NULL, NULL, 'member rows', count(*) FILTER (nm > 0), 0, 0, 0, 0, NULL, NULL, CAST(sum(nm) AS BIGINT) FROM s
    UNION ALL SELECT 'predicate', NULL, NULL, NULL, 'related rows', count(*) FILTER (nr > 0), 0, 0, 0, 0, NULL, NULL, CAST(sum(nr) AS BIGINT) FROM s
    """
)
def state_overview(t: Tables) -> DataFrame:
    number, supplier = F.col("l_linenumber") % 3, F.col("l_suppkey")
    predicate = F.when(number == 0, "member").when(number == 1, "related").otherwise("exact")
    object_id = F.when(supplier % 5 == 0, "none").otherwise(F.concat(F.when(supplier % 2 == 0, "B:").otherwise("X:"), supplier.cast("string")))
    rows = t.lineitem.where("l_quantity > 40").groupBy("l_partkey").agg(F.collect_list(F.struct(predicate.alias("predicate"), object_id.alias("object"), F.when(F.col("l_returnflag") == "R", "Not").alias("modifier"))).alias("mappings"))
    size = F.col("p_size")
    subjects = t.part.join(rows, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.when(size % 3 == 0, "class").otherwise("term").alias("kind"), F.col("p_type").alias("enum"), (size % 4).alias("layer"), F.col("p_partkey").alias("term_id"), (size == 13).alias("retired"), "mappings"
    )
    found = reports.overview(subjects, {"member": "member rows", "related": "related rows"}, "member", "related", "B:", "none")
    return found.withColumns({c: F.col(c).cast("string") for c in ("layer", "first_id", "last_id")})


@query(
    """
    WITH RECURSIVE h AS (SELECT o_custkey AS subject, o_orderpriority AS object, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) AS pos FROM orders GROUP BY 1, 2),
    w AS (SELECT o_custkey AS subject, o_orderpriority AS object, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_totalprice)) AS pos FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
    c AS (SELECT h.subject, h.pos AS a, w.pos AS b FROM h JOIN w ON h.subject = w.subject AND h.object = w.object),
    run(subject, a, b, n) AS (SELECT subject, a, b, 1 FROM c UNION ALL SELECT c.subject, c.a, c.b, run.n + 1 FROM run JOIN c ON c.subject = run.subject AND c.a > run.a AND c.b > run.b),
    l AS (SELECT subject, max(n) AS kept FROM run GROUP BY subject), k AS (SELECT subject, count(*) AS common FROM c GROUP BY subject),
    s AS (SELECT subject, count(*) AS n, string_agg(object, '|' ORDER BY pos) AS line FROM h GROUP BY subject), d AS (SELECT subject, count(*) AS n, string_agg(object, '|' ORDER BY pos) AS line FROM w GROUP BY subject)
    SELECT subject, coalesce(s.n, 0) - coalesce(common, 0) AS deletes, coalesce(d.n, 0) - coalesce(common, 0) AS inserts, coalesce(common, 0) - coalesce(kept, 0) AS moves
    FROM s FULL JOIN d USING (subject) LEFT JOIN k USING (subject) LEFT JOIN l USING (subject) WHERE s.line IS DISTINCT FROM d.line
    """
)
def projection_edits(t: Tables) -> DataFrame:
    """A customer's priorities in the order of orders, against the order by price of those that are not open."""
    ranked = lambda rows, by: rows.groupBy(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("object")).agg(F.min(by).alias("ord"))
    have = ranked(t.orders, "o_orderkey").withColumn("slot", F.lit("exact"))
    wanted = ranked(t.orders.where("o_orderstatus <> 'P'"), "o_totalprice").groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "object"))), lambda s: s["object"]), "|").alias("exact"))
    edits = project.projection_edits(have, wanted, ("exact",))
    count = lambda op: F.size(F.filter("edits", lambda e: e["op"] == op)).cast("long").alias(f"{op}s")
    return edits.select("subject", count("delete"), count("insert"), count("move"))


@query(
    """
    WITH f AS (SELECT l_orderkey AS subject, l_linenumber AS rule, l_shipdate FROM lineitem WHERE l_quantity > 30),
    d AS (SELECT o_orderkey AS subject FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderkey % 3 = 0)
    SELECT rule, count(*) FILTER (subject NOT IN (SELECT subject FROM d) AND subject % 2 = 0) AS n, count(*) AS of FROM f GROUP BY rule HAVING n > 0
    """
)
def lint_page(t: Tables) -> DataFrame:
    """Findings by rule that nobody has decided, of even subjects; rules with none of these are not shown."""
    found = t.lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("rule"))
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "applied").otherwise("withdrawn")
    decisions = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("subject"), status.alias("status"))
    return browse.filtered_groups(found, "rule", browse.not_decided(found, decisions).where("subject % 2 = 0"))


@query("SELECT 'finding-subject' AS rule, CAST(event_id AS VARCHAR) AS subject, 'no subject: ' || event_type AS message FROM events WHERE user_id % 5 < 2")
def subjectless_findings(t: Tables) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    subjects = F.when(F.col("user_id") % 5 == 0, none).when(F.col("user_id") % 5 == 1, F.array(F.lit(" "), F.lit(None))).otherwise(F.array(F.lit(""), F.col("user_id").cast("string")))
    found = validate.subjectless(t.events.select(F.col("event_id").alias("source"), F.col("event_type").alias("rule"), subjects.alias("subjects")))
    return found.select("rule", "subject", "message")


@query(
    """
    SELECT p_type AS class, 's' || p_partkey AS slot, row_number() OVER (PARTITION BY p_type ORDER BY coalesce(CASE WHEN p_size % 11 = 0 THEN true END, false) DESC, p_size % 3 = 0 DESC, p_size % 2 = 0 DESC, 's' || p_partkey) AS place FROM part
    """
)
def slot_order(t: Tables) -> DataFrame:
    size = F.col("p_size")
    slots = t.part.select(F.col("p_type").alias("class"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("slot"), F.when(size % 11 == 0, True).alias("identifier"), (size % 3 == 0).alias("required"), (size % 2 == 0).alias("recommended"))
    return reports.slot_order(slots).select("class", "slot", F.col("place").cast("long").alias("place"))


@query(
    f"""
    WITH RECURSIVE {_RESOLVED},
    u AS (SELECT p_type || ' ' || p_name AS label, count(*) AS files, count(DISTINCT l_orderkey) AS datasets FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT 'delegated' AS what, u.label, target, files, datasets FROM u JOIN res ON u.label = res.label WHERE how = 'delegated'
    UNION ALL SELECT 'unresolved', u.label, NULL, files, datasets FROM u LEFT JOIN res ON u.label = res.label WHERE res.target IS NULL
    """
)
def usage_rest(t: Tables) -> DataFrame:
    label = F.concat_ws(" ", "p_type", "p_name").alias("label")
    usage = t.lineitem.join(t.part.select("p_partkey", label), F.col("l_partkey") == F.col("p_partkey")).groupBy("label").agg(F.count("*").alias("files"), F.count_distinct("l_orderkey").alias("datasets"))
    resolved = _resolved(t)
    left = resolve.unresolved_usage(resolved, usage).select(F.lit("unresolved").alias("what"), "label", F.lit(None).cast("string").alias("target"), "files", "datasets")
    return resolve.delegated_usage(resolved, usage).select(F.lit("delegated").alias("what"), "label", "target", "files", "datasets").unionByName(left)


@query(
    """
    WITH d AS (SELECT l_orderkey AS id, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT id, o_custkey AS subject, 0 AS r FROM d UNION ALL SELECT id, l_suppkey, 1 FROM d UNION ALL SELECT id, l_partkey, 2 FROM d)
    SELECT subject, id, CASE min(r) WHEN 0 THEN 'subject' WHEN 1 THEN 'also' ELSE 'created' END AS role FROM n WHERE subject IN (SELECT c_custkey FROM customer) GROUP BY 1, 2
    """
)
def decisions_of(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("also_affects"), F.collect_set("l_partkey").alias("created"))
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), "also_affects", "created")
    return curation.decisions_of(t.customer.select(F.col("c_custkey").alias("subject")), rows)


@query(
    f"""
    WITH {_FOUND}, d AS (SELECT c_custkey AS subject, c_custkey * 3 AS cites FROM customer WHERE c_mktsegment = 'BUILDING'), live AS (SELECT c_custkey AS sid FROM customer WHERE c_acctbal > -900)
    SELECT source, count(*) AS open FROM f WHERE id NOT IN (SELECT cites FROM d) AND id NOT IN (SELECT id FROM each WHERE node IN (SELECT subject FROM d) OR node NOT IN (SELECT sid FROM live)) GROUP BY source
    """
)
def undecided_live(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    decisions = t.customer.where("c_mktsegment = 'BUILDING'").select(key.alias("id"), key.alias("subject"), F.lit("applied").alias("status"), F.array(key * 3).alias("evidence"))
    subjects = t.customer.select(key.alias("subject"), (F.col("c_acctbal") <= -900).alias("retired"))
    return curation.undecided(_found(t), decisions, subjects).groupBy("source").agg(F.count("*").alias("open"))


@query(
    """
    SELECT p_type, '[' || string_agg('{"p_size":' || p_size || ',"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}', ',' ORDER BY p_size, p_partkey) || ']' AS parts FROM part GROUP BY 1
    """
)
def nested_documents(t: Tables) -> DataFrame:
    return reports.nested(t.part, F.col("p_type"), "parts", "p_size", "p_partkey", "p_name")


@query(
    """
    WITH RECURSIVE e AS (SELECT l_partkey AS src, min(l_suppkey) AS dst FROM lineitem GROUP BY 1)
    SELECT p_partkey AS node, coalesce(dst, p_partkey) AS first_supplier FROM part LEFT JOIN e ON p_partkey = src
    """
)
def first_successor(t: Tables) -> DataFrame:
    listed = t.lineitem.groupBy("l_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), "|").alias("replaced_by"))
    rows = t.part.join(listed, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.select(F.col("p_partkey").alias("node"), F.coalesce(resolve.successor(F.col("replaced_by")).cast("long"), F.col("p_partkey")).alias("first_supplier"))
