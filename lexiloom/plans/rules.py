"""Rules for mapping rows, decompositions, identifiers, decisions and records, over parts, orders, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import curation, project, resolve, validate, verdicts
from lexiloom.plans.registry import Tables, query

_MAP = """
    m AS (SELECT 'P' || (p_partkey // 2) AS subject_id, CASE p_size % 4 WHEN 0 THEN 'skos:exactMatch' WHEN 1 THEN 'skos:relatedMatch' ELSE 'vocab:has_element_type' END AS predicate_id,
                 CASE WHEN p_size % 10 = 3 THEN 'sssom:NoTermFound' WHEN p_size % 7 = 0 THEN 'X:' || p_brand ELSE 'B:' || p_brand END AS object_id,
                 CASE WHEN p_size % 13 = 0 THEN 'thing' ELSE 'set' END AS subject_category, CASE WHEN p_size % 17 = 0 THEN '' ELSE 'element' END AS object_category FROM part),
    live AS (SELECT 'P' || (p_partkey // 2) AS subject_id, p_type AS enum FROM part WHERE p_partkey % 2 = 0),
    k AS (SELECT m.*, enum IN ('PROMO', 'ECONOMY') AS content, object_id IN ('B:Brand#12', 'B:Brand#13') AS attribute FROM m JOIN live USING (subject_id))"""


@query(
    f"""
    WITH {_MAP}
    SELECT 'member-content' AS rule, count(*) AS n FROM k WHERE predicate_id = 'vocab:has_element_type' AND NOT content
    UNION ALL SELECT 'member-object', count(*) FROM k WHERE predicate_id = 'vocab:has_element_type' AND object_id <> 'sssom:NoTermFound' AND object_id NOT LIKE 'B:%'
    UNION ALL SELECT 'attribute-content', count(*) FROM k WHERE attribute AND content
    UNION ALL SELECT 'subject-category', count(*) FROM k WHERE object_id LIKE 'B:%' AND subject_category <> CASE WHEN attribute THEN '' ELSE 'set' END
    UNION ALL SELECT 'object-category', count(*) FROM k WHERE object_id LIKE 'B:%' AND object_category <> CASE WHEN attribute THEN '' ELSE 'element' END
    UNION ALL SELECT 'none-and-member', count(*) FROM (SELECT 1 FROM k WHERE predicate_id = 'vocab:has_element_type' GROUP BY subject_id HAVING bool_or(object_id = 'sssom:NoTermFound') AND bool_or(object_id <> 'sssom:NoTermFound'))
    """
)
def mapping_policy(t: Tables) -> DataFrame:
    size = F.col("p_size")
    subject = F.concat(F.lit("P"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("subject_id")
    object_id = F.when(size % 10 == 3, project.NONE_FOUND).when(size % 7 == 0, F.concat(F.lit("X:"), "p_brand")).otherwise(F.concat(F.lit("B:"), "p_brand"))
    rows = t.part.select(
        subject, F.col("p_name").alias("subject_label"), F.when(size % 4 == 0, "skos:exactMatch").when(size % 4 == 1, "skos:relatedMatch").otherwise("vocab:has_element_type").alias("predicate_id"),
        object_id.alias("object_id"), F.col("p_brand").alias("object_label"), F.lit(None).cast("string").alias("fit"), F.lit(None).cast("string").alias("predicate_modifier"),
        F.when(size % 13 == 0, "thing").otherwise("set").alias("subject_category"), F.when(size % 17 == 0, "").otherwise("element").alias("object_category"),
    )
    live = t.part.where("p_partkey % 2 = 0").select(subject, F.col("p_name").alias("subject_label"), F.col("p_type").alias("enum"))
    objects = t.part.select(F.concat(F.lit("B:"), "p_brand").alias("object_id"), F.col("p_brand").alias("object_label")).distinct()
    policy = validate.MappingPolicy(content=("PROMO", "ECONOMY"), attributes=("B:Brand#12", "B:Brand#13"), prefix="B:", categories=("set", "element"))
    return validate.counted(validate.mapping_violations(rows, live, objects, policy), validate.POLICY_RULES)


def _decomposed(t: Tables) -> DataFrame:
    """A decomposition row for each type and name; its base is the name, in the pool of odd or even sizes, or is missing."""
    base = F.when(F.col("size") % 11 == 0, "").otherwise(F.col("p_name"))
    rows = t.part.groupBy("p_type", "p_name").agg(F.max("p_size").alias("size"))
    return rows.select(F.concat_ws(" ", "p_type", "p_name").alias("term"), F.when(F.col("size") % 2 == 0, "even").otherwise("odd").alias("pool"), base.alias("base"))


_DECOMPOSED = """
    f AS (SELECT p_type || ' ' || p_name AS term, CASE WHEN max(p_size) % 2 = 0 THEN 'even' ELSE 'odd' END AS pool, CASE WHEN max(p_size) % 11 = 0 THEN '' ELSE p_name END AS base FROM part GROUP BY p_type, p_name),
    w AS (SELECT DISTINCT p_name AS name, regexp_extract(p_name, '([^ ]+)$', 1) AS word FROM part),
    pools AS (SELECT 'even' AS pool, word AS name FROM w WHERE length(word) % 2 = 0 UNION SELECT 'odd', word FROM w WHERE length(word) % 3 <> 0),
    v AS (SELECT p_type AS enum, p_name AS label, CASE WHEN max(p_size) % 9 = 0 THEN '' WHEN max(p_size) % 5 = 0 THEN 'ab:' || max(p_partkey) ELSE 'ab:AB_' || lpad(CAST(min(p_size) * 100 + length(p_name) AS VARCHAR), 7, '0') END AS meaning
          FROM part GROUP BY 1, 2)"""


@query(
    f"""
    WITH {_DECOMPOSED},
    ends AS (SELECT f.term, f.pool, f.base, w.word AS chain_end FROM f LEFT JOIN w ON f.base = w.name WHERE f.base <> '')
    SELECT 'facet-no-base' AS rule, count(*) AS n FROM f WHERE base = ''
    UNION ALL SELECT 'facet-unresolved', count(*) FROM ends WHERE (pool, chain_end) NOT IN (SELECT pool, name FROM pools)
    UNION ALL SELECT 'compound-live', count(*) FROM (SELECT DISTINCT term FROM f WHERE term IN (SELECT p_type || ' ' || p_name FROM part WHERE p_size > 45))
    UNION ALL SELECT 'delegation-base', count(DISTINCT base) FROM f WHERE base <> '' AND base NOT IN (SELECT p_name FROM part WHERE p_size > 47)
    UNION ALL SELECT 'id-missing', count(*) FROM v WHERE meaning = ''
    UNION ALL SELECT 'id-form', count(*) FROM v WHERE meaning <> '' AND NOT regexp_full_match(meaning, 'ab:(AB_\\d{{7}})')
    UNION ALL SELECT 'id-repeated', count(*) FROM (SELECT 1 FROM v WHERE meaning <> '' GROUP BY meaning HAVING count(*) > 1)
    UNION ALL SELECT 'import', count(*) FROM (SELECT n_name FROM nation WHERE n_regionkey > 2)
    """
)
def roundtrip_checks(t: Tables) -> DataFrame:
    rows = _decomposed(t)
    word = F.regexp_extract("p_name", "([^ ]+)$", 1)
    names = t.part.select("p_name", word.alias("word")).distinct()
    ends = resolve.chain_ends(names.select(F.col("p_name").alias("node")), names.where("p_name <> word").select(F.col("p_name").alias("src"), F.col("word").alias("dst")))
    even, odd = names.where("length(word) % 2 = 0"), names.where("length(word) % 3 <> 0")
    pools = even.select(F.lit("even").alias("pool"), F.col("word").alias("name")).union(odd.select(F.lit("odd"), "word"))
    big = t.part.where("p_size > 45").select(F.concat_ws(" ", "p_type", "p_name").alias("name"))
    most, least, key = F.max("p_size"), F.min("p_size"), F.max("p_partkey")
    number = F.lpad((least * 100 + F.length("p_name")).cast("string"), 7, "0")
    meaning = F.when(most % 9 == 0, "").when(most % 5 == 0, F.concat(F.lit("ab:"), key.cast("string"))).otherwise(F.concat(F.lit("ab:AB_"), number))
    values = t.part.groupBy(F.col("p_type").alias("enum"), F.col("p_name").alias("label"), "p_name").agg(meaning.alias("meaning"))
    imports = t.nation.select(F.col("n_name").alias("module"), F.col("n_regionkey").alias("import"))
    found = (
        validate.facet_base_checks(rows, ends, pools)
        .unionByName(validate.still_there(rows, "compound-live", "term", big, "name"))
        .unionByName(validate.missing_from(rows.where("base <> ''"), "delegation-base", "base", t.part.where("p_size > 47").select(F.col("p_name").alias("name")), "name"))
        .unionByName(validate.id_checks(values, r"^ab:(AB_\d{7})$"))
        .unionByName(validate.unresolved_imports(imports, t.region.where("r_regionkey <= 2").select(F.col("r_regionkey").alias("module"))))
    )
    rules = ("facet-no-base", "facet-unresolved", "compound-live", "delegation-base", "id-missing", "id-form", "id-repeated", "import")
    return validate.counted(found, rules)


@query(
    """
    WITH h AS (SELECT p_name AS subject, p_type AS slot, CASE WHEN p_size % 5 = 0 THEN 'SO:' || p_brand ELSE 'ED:' || p_brand END AS object FROM part),
    want AS (SELECT p_name AS subject, p_type AS slot, 'ED:' || p_brand AS object FROM part WHERE p_size % 3 <> 0),
    neg AS (SELECT p_name AS subject, p_type AS slot, 'ED:' || p_brand AS object FROM part WHERE p_size % 6 = 0),
    a AS (SELECT CASE WHEN p_size = 1 THEN 'SO:' ELSE 'V:' END || p_partkey AS subject FROM part)
    SELECT 'slot-object' AS rule, count(*) AS n FROM h WHERE object LIKE 'SO:%' AND object NOT IN ('SO:Brand#11', 'SO:Brand#12')
    UNION ALL SELECT 'projection-orphan', count(*) FROM (SELECT * FROM h EXCEPT SELECT * FROM want EXCEPT SELECT * FROM neg)
    UNION ALL SELECT 'projection-missing', count(*) FROM (SELECT * FROM want EXCEPT SELECT * FROM h)
    UNION ALL SELECT 'foreign-subject', count(*) FROM a WHERE subject LIKE 'SO:%'
    """
)
def projection_checks(t: Tables) -> DataFrame:
    row = lambda prefix, where="true": t.part.where(where).select(F.col("p_name").alias("subject"), F.col("p_type").alias("slot"), F.concat(prefix, "p_brand").alias("object"))
    have = row(F.when(F.col("p_size") % 5 == 0, "SO:").otherwise("ED:"))
    axioms = t.part.select(F.concat(F.when(F.col("p_size") == 1, "SO:").otherwise("V:"), F.col("p_partkey").cast("string")).alias("subject"))
    found = validate.slot_objects(have, "SO:", ("SO:Brand#11", "SO:Brand#12")).unionByName(validate.projection_gaps(have, row(F.lit("ED:"), "p_size % 3 <> 0"), row(F.lit("ED:"), "p_size % 6 = 0")))
    return validate.counted(found.unionByName(validate.foreign_subjects(axioms, "SO:")), ("slot-object", "projection-orphan", "projection-missing", "foreign-subject"))


_TERMS = """
    terms AS (SELECT CAST(p_partkey AS BIGINT) AS sid, p_type AS enum FROM part),
    used AS (SELECT DISTINCT l_partkey AS subject, CASE l_linenumber % 3 WHEN 0 THEN 'facet base' WHEN 1 THEN 'scope' ELSE 'upstream' END AS place FROM lineitem WHERE l_quantity > 49)"""


def _terms(t: Tables) -> tuple[DataFrame, DataFrame]:
    place = F.when(F.col("l_linenumber") % 3 == 0, "facet base").when(F.col("l_linenumber") % 3 == 1, "scope").otherwise("upstream")
    return t.part.select(F.col("p_partkey").alias("sid"), F.col("p_type").alias("enum")), t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("subject"), place.alias("place")).distinct()


@query(
    f"""
    WITH {_TERMS},
    op AS (SELECT p_partkey AS id, p_partkey AS subject, CASE WHEN p_size = 5 THEN p_partkey ELSE p_partkey + 1 END AS base, CASE WHEN p_size % 8 = 0 THEN NULL WHEN p_size % 9 = 0 THEN 'odd' ELSE 'brand' END AS axis, p_partkey + 2 AS value FROM part),
    j AS (SELECT op.*, a.enum AS own, b.enum AS base_enum, c.enum AS value_enum, CASE WHEN axis = 'brand' THEN 'MEDIUM' END AS axis_enum, op.subject IN (SELECT p_partkey FROM part WHERE p_size = 7) AS done,
                 op.subject IN (SELECT subject FROM used WHERE place <> 'facet base') AS held
          FROM op LEFT JOIN terms a ON op.subject = a.sid LEFT JOIN terms b ON op.base = b.sid LEFT JOIN terms c ON op.value = c.sid)
    SELECT id, 'not a content term' AS error FROM j WHERE NOT (coalesce(own IN ('PROMO', 'ECONOMY', 'LARGE'), false) AND coalesce(base_enum IN ('PROMO', 'ECONOMY', 'LARGE'), false))
    UNION ALL SELECT id, 'its own base' FROM j WHERE subject = base UNION ALL SELECT id, 'no facet' FROM j WHERE axis IS NULL UNION ALL SELECT id, 'unknown axis' FROM j WHERE axis = 'odd'
    UNION ALL SELECT id, 'value of another enum' FROM j WHERE axis_enum IS NOT NULL AND NOT coalesce(value_enum = axis_enum, false)
    UNION ALL SELECT id, 'already decomposed' FROM j WHERE done UNION ALL SELECT id, 'still referenced' FROM j WHERE held
    """
)
def facet_operations(t: Tables) -> DataFrame:
    terms, used = _terms(t)
    key, size = F.col("p_partkey"), F.col("p_size")
    axis = F.when(size % 8 == 0, F.lit(None)).when(size % 9 == 0, "odd").otherwise("brand")
    operations = t.part.select(key.alias("id"), key.alias("subject"), F.when(size == 5, key).otherwise(key + 1).alias("base"), axis.alias("axis"), (key + 2).alias("value"))
    axes = t.spark.createDataFrame([("brand", "MEDIUM")], "axis string, enum string")
    return validate.facet_operation_errors(operations, terms, axes, t.part.where("p_size = 7").select(key.alias("subject")), used, ("PROMO", "ECONOMY", "LARGE"))


@query(
    f"""
    WITH {_TERMS}, mv AS (SELECT p_partkey AS id, p_partkey AS subject, CASE WHEN p_size % 2 = 0 THEN 'PROMO' ELSE 'SMALL' END AS enum FROM part),
    u AS (SELECT subject, string_agg(place, ',' ORDER BY place) AS places FROM used WHERE place LIKE 'facet%' OR place LIKE 'scope%' GROUP BY 1)
    SELECT mv.id, 'referenced by ' || places AS error FROM mv JOIN terms ON mv.subject = terms.sid JOIN u ON mv.subject = u.subject
    WHERE (terms.enum IN ('PROMO', 'ECONOMY')) <> (mv.enum IN ('PROMO', 'ECONOMY'))
    """
)
def cross_moves(t: Tables) -> DataFrame:
    terms, used = _terms(t)
    key = F.col("p_partkey")
    moves = t.part.select(key.alias("id"), key.alias("subject"), F.when(F.col("p_size") % 2 == 0, "PROMO").otherwise("SMALL").alias("enum"))
    return validate.cross_moves(moves, terms, used, ("PROMO", "ECONOMY"))


@query(
    """
    WITH r AS (SELECT CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE o_orderkey END AS id, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN '' ELSE o_orderpriority END AS priority, o_orderstatus AS status, 'C' || o_custkey AS owner FROM orders)
    SELECT 'required-priority' AS rule, count(*) AS n FROM r WHERE priority = '' UNION ALL SELECT 'range-status', count(*) FROM r WHERE status NOT IN ('O', 'F')
    UNION ALL SELECT 'pattern-owner', count(*) FROM r WHERE NOT regexp_matches(owner, '^C\\d{1,2}$') UNION ALL SELECT 'identifier', count(*) FROM (SELECT 1 FROM r GROUP BY id HAVING count(*) > 1)
    """
)
def record_checks(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.when(F.col("o_orderkey") % 41 == 0, 0).otherwise(F.col("o_orderkey")).alias("id"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000), "").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("owner"),
    )
    found = validate.record_violations(rows, "id", ("priority",), {"status": ("O", "F")}, {"owner": r"^C\d{1,2}$"})
    return validate.counted(found, ("required-priority", "range-status", "pattern-owner", "identifier"))


@query(
    """
    WITH d AS (SELECT o_orderkey AS id, o_orderpriority AS p, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS b, o_orderkey % 5 <> 0 AS why FROM orders)
    SELECT id, 'missing label' AS error FROM d WHERE p = '1-URGENT' AND NOT a UNION ALL SELECT id, 'unknown field into' FROM d WHERE p = '1-URGENT' AND b
    UNION ALL SELECT id, CASE WHEN b THEN 'missing mappings' ELSE 'missing into,mappings' END FROM d WHERE p = '2-HIGH'
    UNION ALL SELECT id, 'unknown field label' FROM d WHERE p = '2-HIGH' AND a
    UNION ALL SELECT id, 'unknown field ' || CASE WHEN a AND b THEN 'into,label' WHEN a THEN 'label' ELSE 'into' END FROM d WHERE p IN ('3-MEDIUM', '4-NOT SPECIFIED') AND (a OR b)
    UNION ALL SELECT id, 'one group of fields' FROM d WHERE p = '4-NOT SPECIFIED' UNION ALL SELECT id, 'unknown verdict' FROM d WHERE p = '5-LOW'
    UNION ALL SELECT id, 'no rationale' FROM d WHERE p IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') AND NOT why
    """
)
def verdict_checks(t: Tables) -> DataFrame:
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    verdict = F.when(priority == "1-URGENT", "rename").when(priority == "2-HIGH", "merge").when(priority == "3-MEDIUM", "defer").when(priority == "4-NOT SPECIFIED", "add_slot").otherwise("no such verdict")
    given = F.array_compact(F.array(F.when(key % 2 == 0, F.lit("label")), F.when(key % 3 == 0, F.lit("into"))))
    rows = t.orders.select(key.alias("id"), F.when(priority == "4-NOT SPECIFIED", "class").otherwise("term").alias("kind"), verdict.alias("verdict"), given.alias("given"), F.when(key % 5 != 0, "why").alias("rationale"))
    return verdicts.verdict_errors(rows, verdicts.verdict_table(t.spark))


@query(
    """
    WITH r AS (SELECT s_suppkey AS report, CASE WHEN s_nationkey % 3 = 0 THEN 'old' ELSE 'now' END AS fingerprint, CASE WHEN s_acctbal > 0 THEN 'h' ELSE '' END AS source_hash, CASE WHEN s_suppkey % 4 = 0 THEN 'm2' ELSE 'm1' END AS model FROM supplier)
    SELECT report, CASE WHEN fingerprint <> 'now' THEN 'schema fingerprint differs' WHEN source_hash = '' THEN 'no source hash' ELSE 'another model' END AS error FROM r WHERE fingerprint <> 'now' OR source_hash = '' OR model <> 'm1'
    """
)
def provenance_gates(t: Tables) -> DataFrame:
    reports = t.supplier.select(
        F.col("s_suppkey").alias("report"), F.when(F.col("s_nationkey") % 3 == 0, "old").otherwise("now").alias("fingerprint"), F.when(F.col("s_acctbal") > 0, "h").otherwise("").alias("source_hash"),
        F.when(F.col("s_suppkey") % 4 == 0, "m2").otherwise("m1").alias("model"),
    )
    return validate.provenance_errors(reports, "now", "m1")


@query(
    """
    WITH s AS (SELECT 's' || p_partkey AS slot, p_size % 3 = 0 AS required, p_size % 6 = 0 AS identifier, p_size % 4 AS examples, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE 'C' || (p_partkey % 20) END AS range FROM part),
    u AS (SELECT DISTINCT 'C' || (l_suppkey % 20) AS class, 's' || l_partkey AS slot FROM lineitem WHERE l_quantity > 48),
    e AS (SELECT DISTINCT p_brand AS enum, CASE WHEN length(p_brand) = 7 THEN 'class' ELSE 'enum' END AS kind FROM part),
    c AS (SELECT 'C' || s_suppkey AS class, s_nationkey % 3 AS layer, CASE WHEN s_acctbal > 5000 THEN 'x' ELSE '' END AS alignment FROM supplier WHERE s_suppkey < 20)
    SELECT 'required-policy' AS rule, count(*) AS n FROM s WHERE required AND NOT identifier UNION ALL SELECT 'slot-no-examples', count(*) FROM s WHERE examples < 1
    UNION ALL SELECT 'unused-slot', count(*) FROM s WHERE slot NOT IN (SELECT slot FROM u) UNION ALL SELECT 'shared-slot', count(*) FROM (SELECT 1 FROM u GROUP BY slot HAVING count(DISTINCT class) > 1)
    UNION ALL SELECT 'unused-enum', count(*) FROM e WHERE enum NOT IN (SELECT range FROM s) UNION ALL SELECT 'inline-enum', count(*) FROM e WHERE kind = 'class'
    UNION ALL SELECT 'class-no-alignment', count(*) FROM c WHERE alignment = ''
    UNION ALL SELECT 'layer-violation', count(DISTINCT u.class) FROM u JOIN s ON u.slot = s.slot JOIN c ON u.class = c.class JOIN c r ON s.range = r.class WHERE c.layer < r.layer
    """
)
def schema_lint(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    size = F.col("p_size")
    slots = t.part.select(
        name("s", "p_partkey").alias("slot"), (size % 3 == 0).alias("required"), (size % 6 == 0).alias("identifier"), F.array_repeat(F.lit("e"), (size % 4).cast("int")).alias("examples"),
        F.when(size % 5 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("C"), (F.col("p_partkey") % 20).cast("string"))).alias("range"),
    )
    uses = t.lineitem.where("l_quantity > 48").select(F.concat(F.lit("C"), (F.col("l_suppkey") % 20).cast("string")).alias("class"), name("s", "l_partkey").alias("slot")).distinct()
    enums = t.part.select(F.col("p_brand").alias("enum"), F.when(F.length("p_brand") == 7, "class").otherwise("enum").alias("module_kind")).distinct()
    classes = t.supplier.where("s_suppkey < 20").select(name("C", "s_suppkey").alias("class"), (F.col("s_nationkey") % 3).alias("layer"), F.when(F.col("s_acctbal") > 5000, "x").otherwise("").alias("alignment"))
    rules = ("required-policy", "slot-no-examples", "unused-slot", "shared-slot", "unused-enum", "inline-enum", "class-no-alignment", "layer-violation")
    return validate.counted(curation.schema_lint(slots, uses, enums, classes), rules)


@query(
    """
    WITH o AS (SELECT p_partkey AS subject, CASE WHEN p_size % 2 = 0 THEN 'has_element_type' ELSE 'closeMatch' END AS predicate, p_brand AS object, CASE WHEN p_size % 3 = 0 THEN 'given' ELSE '' END AS label, p_size % 7 = 0 AS negate FROM part),
    n AS (SELECT DISTINCT p_brand AS object, lower(p_brand) AS name FROM part WHERE p_brand <> 'Brand#12')
    SELECT subject, predicate, o.object, CASE WHEN label <> '' THEN label ELSE coalesce(name, '') END AS object_label, CASE WHEN predicate = 'has_element_type' AND NOT negate THEN 'exact' ELSE '' END AS fit,
           CASE WHEN negate THEN 'Not' ELSE '' END AS modifier, CASE WHEN predicate = 'has_element_type' THEN 'set' ELSE '' END AS subject_category, CASE WHEN predicate = 'has_element_type' THEN 'element' ELSE '' END AS object_category
    FROM o LEFT JOIN n ON o.object = n.object
    """
)
def mapping_fill(t: Tables) -> DataFrame:
    size = F.col("p_size")
    operations = t.part.select(
        F.col("p_partkey").alias("subject"), F.when(size % 2 == 0, "has_element_type").otherwise("closeMatch").alias("predicate"), F.col("p_brand").alias("object"),
        F.when(size % 3 == 0, "given").otherwise("").alias("object_label"), F.lit("exact").alias("fit"), (size % 7 == 0).alias("negate"),
    )
    names = t.part.where("p_brand <> 'Brand#12'").select(F.col("p_brand").alias("object"), F.lower("p_brand").alias("name")).distinct()
    return curation.mapping_fill(operations, names, "has_element_type", ("set", "element"))


@query(
    """
    WITH l AS (SELECT DISTINCT p_name AS label, p_type AS enum FROM part WHERE p_size = 50),
    p AS (SELECT 'facet base' AS place, p_name AS label, p_type AS enum, p_partkey AS holder FROM part WHERE p_size < 10 UNION ALL SELECT 'scope', p_name, '', p_partkey FROM part WHERE p_size = 10)
    SELECT l.label, place, holder FROM p JOIN l ON p.label = l.label AND (p.enum = '' OR p.enum = l.enum)
    """
)
def label_references(t: Tables) -> DataFrame:
    labels = t.part.where("p_size = 50").select(F.col("p_name").alias("label"), F.col("p_type").alias("enum")).distinct()
    place = lambda name, where, enum: t.part.where(where).select(F.lit(name).alias("place"), F.col("p_name").alias("label"), enum.alias("enum"), F.col("p_partkey").alias("holder"))
    return curation.references(labels, place("facet base", "p_size < 10", F.col("p_type")).union(place("scope", "p_size = 10", F.lit(""))))


@query(
    """
    WITH o AS (SELECT o_orderkey AS id, o_orderkey % 12 AS n, o_custkey % 4 AS m, 'c:' || o_custkey AS sid, c_mktsegment AS seg, c_acctbal > 0 AS live FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
    k AS (SELECT *, CASE seg WHEN 'AUTOMOBILE' THEN 'class' WHEN 'BUILDING' THEN 'term' WHEN 'FURNITURE' THEN 'slot' WHEN 'HOUSEHOLD' THEN 'enum' ELSE 'subset' END AS is_a FROM o),
    want AS (SELECT *, CASE n WHEN 0 THEN 'into' WHEN 1 THEN 'subsets' WHEN 2 THEN 'is_a' END AS field, CASE n WHEN 0 THEN 'term' WHEN 1 THEN 'subset' WHEN 2 THEN 'class' END AS of FROM k)
    SELECT id, field, CASE WHEN seg IS NULL THEN 'no subject ' || sid WHEN is_a <> of THEN sid || ' is a ' || is_a ELSE sid || ' is not live' END AS error FROM want WHERE n < 3 AND NOT (n = 2 AND m = 0) AND (seg IS NULL OR is_a <> of OR NOT live)
    UNION ALL SELECT id, 'mappings', CASE m WHEN 0 THEN 'not one of move|drop' ELSE 'null' END FROM o WHERE n = 0 AND m < 2
    UNION ALL SELECT id, 'description', CASE m WHEN 2 THEN 'null' ELSE 'no str' END FROM o WHERE n = 3 AND m > 0
    UNION ALL SELECT id, 'layer', 'no int' FROM o WHERE n = 4 AND m > 0
    UNION ALL SELECT id, 'delete_def', 'no bool' FROM o WHERE n = 5 AND m = 1 UNION ALL SELECT id, NULL, 'missing slot' FROM o WHERE n = 5
    UNION ALL SELECT id, 'see_also', 'no str_list' FROM o WHERE n = 6 AND m > 1 UNION ALL SELECT id, NULL, 'one group of fields' FROM o WHERE n = 6 AND m = 0
    UNION ALL SELECT id, NULL, 'the operation is no object' FROM o WHERE n = 7 UNION ALL SELECT id, 'op', 'names another verdict' FROM o WHERE n = 8
    UNION ALL SELECT id, NULL, 'only a seed records this' FROM o WHERE n = 9 AND m > 0 UNION ALL SELECT id, 'rule', 'no map' FROM o WHERE n = 10 UNION ALL SELECT id, NULL, 'no rationale' FROM o WHERE n = 11
    """
)
def typed_operations(t: Tables) -> DataFrame:
    """Decisions of twelve shapes, one an order; customers are the subjects that their fields name."""
    key, m = F.col("o_orderkey"), F.col("o_custkey") % 4
    n, sid = key % 12, F.concat(F.lit('"c:'), F.col("o_custkey").cast("string"), F.lit('"'))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    pick = lambda *values: F.element_at(F.array(*(F.lit(v) for v in values)), (m + 1).cast("int"))
    shapes = [
        ("term", "merge", text('{"op":"merge","into":', sid, ',"mappings":', pick('"keep"', "null", '"move"', '"drop"'), "}")), ("term", "set_subsets", text('{"subsets":[', sid, ",", sid, "]}")),
        ("class", "set_is_a", text('{"is_a":', F.when(m == 0, "null").otherwise(sid), "}")), ("enum", "edit_description", text('{"description":', pick('"said"', '" "', "null", "7"), "}")),
        ("module", "set_layer", text('{"layer":', pick("2", "2.5", '"2"', "true"), "}")), ("class", "drop_slot", text('{"delete_def":', pick("true", "1", "false", "true"), "}")),
        ("class", "set_lineage", pick("{}", '{"see_also":["a"]}', '{"see_also":["a",""]}', '{"see_also":"a"}')), ("term", "keep", F.lit("[1]")), ("term", "keep", F.lit('{"op":"delete"}')), ("term", "mint_base", F.lit('{"note":"n"}')),
        ("class", "add_rule", F.lit('{"rule":["a"]}')), ("slot", "keep", F.lit(None).cast("string")),
    ]
    at = lambda k: F.element_at(F.array(*(s[k] if k == 2 else F.lit(s[k]) for s in shapes)), (n + 1).cast("int"))
    rows = t.orders.select(key.alias("id"), at(0).alias("kind"), at(1).alias("verdict"), F.when(n != 11, "why").alias("rationale"), F.when(m == 0, "seed").otherwise("review").alias("origin"), at(2).alias("operation"))
    segment = F.col("c_mktsegment")
    kind = F.when(segment == "AUTOMOBILE", "class").when(segment == "BUILDING", "term").when(segment == "FURNITURE", "slot").when(segment == "HOUSEHOLD", "enum").otherwise("subset")
    subjects = t.customer.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("sid"), kind.alias("kind"), (F.col("c_acctbal") > 0).alias("live"))
    return verdicts.operation_errors(rows, subjects)


@query(
    """
    WITH d AS (SELECT p_partkey AS id, p_partkey % 4 = 3 AS negate, CASE p_size % 3 WHEN 0 THEN 'vocab:has_element_type' WHEN 1 THEN 'skos:exactMatch' ELSE 'skos:relatedMatch' END AS predicate,
                      CASE WHEN p_size % 10 = 9 THEN 'sssom:NoTermFound' WHEN p_size % 4 = 0 THEN 'X:' || p_brand ELSE 'B:' || p_brand END AS object, CASE p_size % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'odd' WHEN 2 THEN 'not_applicable' ELSE '' END AS fit FROM part),
    k AS (SELECT *, predicate = 'vocab:has_element_type' AS member, object LIKE 'B:%' AS target, object = 'sssom:NoTermFound' AS none FROM d)
    SELECT id, 'membership needs an object of the target' AS error FROM k WHERE member AND NOT target AND NOT none
    UNION ALL SELECT id, 'membership needs a fit' FROM k WHERE member AND NOT negate AND fit NOT IN ('exact', 'broad', 'approximate', 'not_applicable')
    UNION ALL SELECT id, 'the predicate is banned for this object' FROM k WHERE predicate = 'skos:exactMatch' AND target AND NOT negate AND object NOT IN ('B:Brand#1', 'B:Brand#2')
    UNION ALL SELECT id, 'only membership has a fit' FROM k WHERE fit <> '' AND NOT member
    UNION ALL SELECT id, 'none found needs membership and not_applicable' FROM k WHERE none AND NOT (member AND fit = 'not_applicable')
    """
)
def mapping_operations(t: Tables) -> DataFrame:
    size = F.col("p_size")
    predicate = F.when(size % 3 == 0, "vocab:has_element_type").when(size % 3 == 1, "skos:exactMatch").otherwise("skos:relatedMatch")
    object_id = F.when(size % 10 == 9, project.NONE_FOUND).when(size % 4 == 0, F.concat(F.lit("X:"), "p_brand")).otherwise(F.concat(F.lit("B:"), "p_brand"))
    fit = F.when(size % 5 == 0, "exact").when(size % 5 == 1, "odd").when(size % 5 == 2, "not_applicable")
    operation = F.to_json(F.struct(predicate.alias("predicate"), object_id.alias("object"), fit.alias("element_type_fit")))
    rows = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 3, "reject_mapping").otherwise("adopt_mapping").alias("verdict"), operation.alias("operation"))
    policy = validate.MappingPolicy(banned=("skos:exactMatch",), licensed=("B:Brand#1",), attributes=("B:Brand#2",), prefix="B:")
    return verdicts.mapping_operation_errors(rows, policy)
