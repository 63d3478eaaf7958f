"""Similarity and lexical matching over embeddings and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators import lexical, reports, similarity
from lexiloom.plans.registry import Tables, query
from lexiloom.plans.textual import _NORM, _SING
from lexiloom.session import durable

#: On these vectors the reference thresholds find nothing; the operators take any.
NEAR, PAIR = 0.25, 0.30

_V = """
    v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, q.label AS q_label, t.vec_id AS target_id, t.label AS t_label, round(list_dot_product(q.e, t.e) / (q.n * t.n), 12) AS score
          FROM v q JOIN v t ON q.vec_id <> t.vec_id)"""


def _vectors(t: Tables) -> DataFrame:
    """All vectors: each is a query, and every other one is a target."""
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("part"))


def _matches(t: Tables, k: int = 5) -> DataFrame:
    rows = _vectors(t)
    return similarity.top_k(rows, rows.drop("part"), k, NEAR, others=True)


def _six(rows: DataFrame) -> DataFrame:
    """Scores as they are shown: rounded after ranks and thresholds."""
    return rows.withColumn("similarity", F.round("similarity", 6))


@query(
    f"""
    WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS rank FROM s)
    SELECT query_id, target_id, rank, round(score, 6) AS similarity,
           CASE WHEN query_id % 10 = target_id % 10 THEN 'confirmed' WHEN score >= 0.85 THEN 'strong' WHEN score >= 0.7 THEN 'moderate' ELSE 'weak' END AS kind
    FROM r WHERE rank <= 5 AND score >= {NEAR}
    """
)
def knn_topk(t: Tables) -> DataFrame:
    # an existing mapping, to the last digit of the query's id, confirms targets of that digit
    digit = lambda c: F.concat(F.lit("d"), (F.col(c) % 10).cast("string"))
    kind = similarity.match_kind(F.col("similarity"), digit("target_id"), F.concat(F.lit("map:"), digit("query_id")))
    return _six(_matches(t).select("query_id", "target_id", F.col("rank").cast("long").alias("rank"), "similarity", kind.alias("kind")))


@query(
    f"""
    WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, t_label ORDER BY score DESC, target_id) AS rank FROM s)
    SELECT query_id, CAST(t_label AS VARCHAR) AS part, target_id, rank, round(score, 6) AS similarity FROM r WHERE rank <= 3 AND score >= {NEAR}
    """
)
def knn_by_ontology(t: Tables) -> DataFrame:
    found = similarity.top_k(_vectors(t), _vectors(t), 3, NEAR, by_part=True, others=True)
    return _six(found.select("query_id", "part", "target_id", F.col("rank").cast("long").alias("rank"), "similarity"))


_PAIRS = f"""
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
    p AS (SELECT a.vec_id AS id1, b.vec_id AS id2, round(list_dot_product(a.e, b.e) / (a.n * b.n), 12) AS score, a.label <> b.label AS crosses FROM v a JOIN v b ON a.vec_id < b.vec_id)
    SELECT id1, id2, round(score, 6) AS similarity, crosses, CASE WHEN crosses THEN 'review_cross_category' WHEN score > 0.95 THEN 'merge' WHEN score > 0.85 THEN 'hierarchy' ELSE 'consolidate' END AS recommendation
    FROM p WHERE score >= {PAIR}
    """


def near_pairs(t: Tables) -> DataFrame:
    return similarity.self_pairs(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), PAIR)


@query(_PAIRS)
def self_pairs(t: Tables) -> DataFrame:
    rows, pairs = t.embeddings, near_pairs(t)
    a, b = (rows.select(F.col("vec_id").alias(f"id{k}"), F.col("label").alias(f"label{k}")) for k in (1, 2))
    crosses = F.col("label1") != F.col("label2")
    pairs = pairs.join(a, "id1").join(b, "id2").withColumn("crosses", crosses)
    return _six(pairs.select("id1", "id2", "similarity", "crosses", similarity.recommendation(F.col("similarity"), F.col("crosses")).alias("recommendation")))


@query(
    f"""
    WITH p AS ({_PAIRS})
    SELECT count(*) AS total_pairs, count(*) FILTER (crosses) AS cross_category, count(*) FILTER (recommendation = 'merge') AS merges, max(similarity) AS most FROM p
    """
)
def pair_summary(t: Tables) -> DataFrame:
    return reports.pair_totals(self_pairs(t))


@query(
    f"""
    WITH p AS ({_PAIRS})
    SELECT 'sim:' || substr(sha1(least('T' || id1, 'T' || id2) || '|' || greatest('T' || id1, 'T' || id2)), 1, 12) AS id,
           least('term:' || id1, 'term:' || id2) || ',' || greatest('term:' || id1, 'term:' || id2) AS subjects, round(similarity, 4) AS similarity, crosses AS crosses_categories, recommendation FROM p
    """
)
def pair_report(t: Tables) -> DataFrame:
    pairs = self_pairs(t).select(*(F.concat(F.lit("T"), F.col(c).cast("string")).alias(c) for c in ("id1", "id2")), "similarity", "crosses", "recommendation")
    subject = lambda c: F.concat(F.lit("term:"), F.substring(c, 2, 30))
    return reports.pair_report(pairs.select("*", subject("id1").alias("sid1"), subject("id2").alias("sid2")))


_BEST = f"""
    {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS rank FROM s),
    m AS (SELECT * FROM r WHERE rank <= 5 AND score >= {NEAR}),
    b AS (SELECT v.vec_id AS query_id, v.label, round(coalesce(max(m.score), 0.0), 6) AS max_similarity, min(CASE WHEN rank = 1 THEN target_id END) AS best_id
          FROM v LEFT JOIN m ON v.vec_id = m.query_id GROUP BY 1, 2)"""


def _best_of(t: Tables, matches: DataFrame) -> DataFrame:
    return similarity.best_match(_vectors(t), matches).withColumn("max_similarity", F.round("max_similarity", 6))


@query(f"WITH {_BEST} SELECT query_id, max_similarity, best_id FROM b")
def best_match(t: Tables) -> DataFrame:
    return _best_of(t, _matches(t))


@query(
    f"""
    WITH {_BEST}
    SELECT label, count(*) AS total, count(*) FILTER (max_similarity < 0.3) AS gaps, round(100.0 * count(*) FILTER (max_similarity < 0.3) / count(*), 1) AS gap_percent,
           round(max(max_similarity) FILTER (max_similarity < 0.3), 4) AS max_gap, round(avg(max_similarity) FILTER (max_similarity < 0.3), 4) AS avg_gap
    FROM b GROUP BY label
    """
)
def gap_analysis(t: Tables) -> DataFrame:
    labels = t.embeddings.select(F.col("vec_id").alias("query_id"), "label")
    return similarity.gaps(best_match(t).join(labels, "query_id"), "label", 0.3)


@query(
    f"""
    WITH {_BEST}
    SELECT CASE WHEN max_similarity >= 0.4 THEN 'high' WHEN max_similarity >= 0.3 THEN 'middle' ELSE 'low' END AS bin, count(*) AS n FROM b GROUP BY 1
    """
)
def run_summary_bins(t: Tables) -> DataFrame:
    s = F.col("max_similarity")
    return best_match(t).groupBy(F.when(s >= 0.4, "high").when(s >= 0.3, "middle").otherwise("low").alias("bin")).agg(F.count("*").alias("n"))


def _lexicon(t: Tables) -> DataFrame:
    names = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("row_no"))
    terms = names.select(F.col("p_name").alias("term_id"), F.col("p_name").alias("name"), F.array(F.upper("p_name"), F.lit("")).alias("synonyms"), "row_no")
    return lexical.index(terms)


def _asked(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 0, F.concat("p_name", F.lit("s"))).when(kind == 1, F.concat_ws(" ", "p_type", F.concat("p_name", F.lit("s")))).when(kind == 2, F.col("p_name")).otherwise(F.lit("no such thing"))
    return t.part.select(F.col("p_partkey").alias("query_id"), text.alias("text"))


_TEXT = "CASE p_partkey % 4 WHEN 0 THEN p_name || 's' WHEN 1 THEN p_type || ' ' || p_name || 's' WHEN 2 THEN p_name ELSE 'no such thing' END"


def _forms(source: str) -> str:
    """SQL: (id, form_no, start, phrase) of the suffix forms of (id, v) in `source`."""
    return f"""
    kk AS (SELECT id, string_split(v, ' ') AS words, unnest(range(len(string_split(v, ' ')))) AS start FROM {source} WHERE v <> ''),
    pp AS (SELECT id, start, array_to_string(words[start + 1:], ' ') AS phrase, words[len(words)] AS w FROM kk),
    ss AS (SELECT *, {_SING} AS one FROM pp),
    forms AS (SELECT id, 2 * start AS form_no, start, phrase FROM ss
              UNION ALL SELECT id, 2 * start + 1, start, regexp_replace(phrase, '[^ ]*$', '') || one FROM ss WHERE one IS NOT NULL)"""


_LEX = f"""
    terms AS (SELECT p_name AS term_id, min(p_partkey) AS row_no FROM part GROUP BY p_name),
    labels AS (SELECT term_id, row_no, 0 AS label_no, 'name' AS label_kind, term_id AS label, {_NORM.format("term_id")} AS v FROM terms
               UNION ALL SELECT term_id, row_no, 1, 'synonym', upper(term_id), {_NORM.format("upper(term_id)")} FROM terms),
    lw AS (SELECT *, regexp_extract(v, '([^ ]*)$', 1) AS w FROM labels),
    lv AS (SELECT *, {_SING} AS one FROM lw),
    lex AS (SELECT term_id, row_no, label_no, label_kind, label, v AS variant FROM lv
            UNION ALL SELECT term_id, row_no, label_no, label_kind, label, regexp_replace(v, '[^ ]*$', '') || one FROM lv WHERE one IS NOT NULL),
    asked AS (SELECT p_partkey AS id, {_NORM.format(_TEXT)} AS v FROM part),
    {_forms("asked")},
    hits AS (SELECT f.id AS query_id, f.form_no, f.start, l.* FROM forms f JOIN lex l ON f.phrase = l.variant),
    won AS (SELECT * FROM hits QUALIFY form_no = min(form_no) OVER (PARTITION BY query_id)),
    one_each AS (SELECT * FROM won QUALIFY row_number() OVER (PARTITION BY query_id, term_id ORDER BY row_no, label_no) = 1),
    found AS (SELECT query_id, term_id, label, label_kind, variant AS matched_on, CASE WHEN start = 0 THEN 'lexical' ELSE 'lexical-suffix' END AS match_kind,
                     start AS suffix_start, row_number() OVER (PARTITION BY query_id ORDER BY row_no, label_no, term_id) AS hit_no FROM one_each)"""


@query(f"WITH {_LEX} SELECT * FROM found")
def lexical_search(t: Tables) -> DataFrame:
    found = lexical.search(_asked(t), _lexicon(t))
    return found.withColumns({c: F.col(c).cast("long") for c in ("suffix_start", "hit_no")})


@query(
    f"""
    WITH {_LEX},
    whole AS (SELECT DISTINCT f.id FROM forms f JOIN lex l ON f.phrase = l.variant WHERE f.start = 0),
    anyone AS (SELECT DISTINCT query_id AS id FROM hits)
    SELECT 'whole' AS kind, count(*) AS n FROM whole UNION ALL SELECT 'any', count(*) FROM anyone
    """
)
def lexical_semi(t: Tables) -> DataFrame:
    asked, lexicon = _asked(t), durable(_lexicon(t), "lexicon")
    count = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("whole", lexical.whole_name_matches(asked, lexicon)).union(count("any", lexical.any_matches(asked, lexicon)))


def _brand_terms(t: Tables) -> DataFrame:
    """The largest part of each name in each brand: a stand-in for the terms that are near a brand's parts."""
    return t.part.groupBy("p_brand", F.col("p_name").alias("term_id")).agg(F.max("p_size").alias("size"))


def _scores(t: Tables) -> DataFrame:
    """Scores of the terms of a part's own brand for each part: a stand-in for a similarity table."""
    asked = t.part.select(F.col("p_partkey").alias("query_id"), "p_brand", F.col("p_size").alias("own"))
    return asked.join(_brand_terms(t), "p_brand").select("query_id", "term_id", F.round(1 - F.abs(F.col("own") - F.col("size")) / 100.0, 4).alias("score"))


@query(
    f"""
    WITH {_LEX},
    t AS (SELECT p_brand, p_name AS term_id, max(p_size) AS size FROM part GROUP BY 1, 2),
    sc AS (SELECT q.p_partkey AS query_id, t.term_id, round(1 - abs(q.p_size - t.size) / 100.0, 4) AS score FROM part q JOIN t ON q.p_brand = t.p_brand),
    a AS (SELECT f.query_id, f.term_id, coalesce(sc.score, 0.0) AS score, f.match_kind, 0 AS tier, f.hit_no AS ord FROM found f LEFT JOIN sc ON f.query_id = sc.query_id AND f.term_id = sc.term_id),
    b AS (SELECT sc.query_id, sc.term_id, sc.score, 'embedding' AS match_kind, 1 AS tier, row_number() OVER (PARTITION BY sc.query_id ORDER BY sc.score DESC, sc.term_id) AS ord
          FROM sc ANTI JOIN found f ON sc.query_id = f.query_id AND sc.term_id = f.term_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, ord) AS rank, term_id, score, match_kind
    FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE ord <= 5)
    """
)
def blend_candidates(t: Tables) -> DataFrame:
    out = lexical.blend(lexical.search(_asked(t), _lexicon(t)), _scores(t), 5)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""
    WITH {_LEX},
    v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
    t AS (SELECT term_id, row_no, e, n FROM terms JOIN v ON row_no = vec_id),
    sc AS (SELECT q.vec_id AS query_id, t.term_id, t.row_no, round(list_dot_product(q.e, t.e) / (q.n * t.n), 12) AS score FROM v q JOIN part ON q.vec_id = p_partkey CROSS JOIN t),
    mine AS (SELECT f.* FROM found f JOIN v ON f.query_id = v.vec_id),
    a AS (SELECT f.query_id, f.term_id, coalesce(sc.score, 0.0) AS score, f.match_kind, 0 AS tier, f.hit_no AS ord FROM mine f LEFT JOIN sc ON f.query_id = sc.query_id AND f.term_id = sc.term_id),
    b AS (SELECT sc.query_id, sc.term_id, sc.score, 'embedding' AS match_kind, 1 AS tier, row_number() OVER (PARTITION BY sc.query_id ORDER BY sc.score DESC, sc.term_id) AS ord
          FROM sc ANTI JOIN mine f ON sc.query_id = f.query_id AND sc.term_id = f.term_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, ord) AS rank, term_id, round(score, 6) AS score, match_kind FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE ord <= 5)
    """
)
def blend_vectors(t: Tables) -> DataFrame:
    """Parts that have a vector, by their texts and their vectors, against names with the vector of their first part."""
    vectors = t.embeddings.select("vec_id", "embedding")
    asked = _asked(t).join(vectors, F.col("query_id") == F.col("vec_id")).drop("vec_id")
    targets = t.part.groupBy(F.col("p_name").alias("term_id")).agg(F.min("p_partkey").alias("row_no")).join(vectors, F.col("row_no") == F.col("vec_id")).drop("vec_id")
    out = lexical.blend_vectors(asked, _lexicon(t), targets, 5)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "term_id", F.round("score", 6).alias("score"), "match_kind")


@query(
    f"""
    WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, t_label ORDER BY score DESC, target_id) AS rank FROM s),
    m AS (SELECT * FROM r WHERE rank <= 3 AND score >= {NEAR})
    SELECT v.vec_id AS query_id, count(target_id) AS matches, count(DISTINCT t_label) AS ontologies, round(coalesce(max(score), 0.0), 6) AS max_similarity,
           coalesce(string_agg(target_id || '=' || printf('%.4f', round(score, 4)), ';' ORDER BY round(score, 4) DESC, CAST(t_label AS VARCHAR), rank), '') AS listed
    FROM v LEFT JOIN m ON v.vec_id = m.query_id GROUP BY v.vec_id
    """
)
def mapping_report(t: Tables) -> DataFrame:
    found = similarity.top_k(_vectors(t), _vectors(t), 3, NEAR, by_part=True, others=True)
    report = reports.mapping_report(_vectors(t), found)
    return report.select("query_id", "matches", "ontologies", F.round("max_similarity", 6).alias("max_similarity"), "listed")


@query(
    f"""
    WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, t_label ORDER BY score DESC, target_id) AS rank FROM s),
    b AS (SELECT v.vec_id, max(score) AS m FROM v LEFT JOIN (SELECT * FROM r WHERE rank <= 3 AND score >= {NEAR}) k ON v.vec_id = k.query_id GROUP BY 1)
    SELECT count(*) AS total_terms, count(m) AS terms_with_matches, round(100.0 * (count(*) - count(m)) / count(*), 1) AS without_percent FROM b
    """
)
def mapping_totals(t: Tables) -> DataFrame:
    found = similarity.top_k(_vectors(t), _vectors(t), 3, NEAR, by_part=True, others=True)
    return reports.mapping_totals(reports.mapping_report(_vectors(t), found))


@query(
    """
    WITH r AS (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_name) AS n FROM (SELECT DISTINCT p_type, p_name FROM part))
    SELECT p_type, p_name FROM r WHERE n <= 8
    """
)
def siblings(t: Tables) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("p_type").orderBy("p_name"))
    return t.part.select("p_type", "p_name").distinct().withColumn("n", number).where("n <= 8").drop("n")
