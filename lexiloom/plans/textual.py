"""Text functions and identifiers over parts, documents and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.plans.registry import Tables, query

_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[_\\-/]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
#: The singular of a last word in SQL, by the same fixed values.
_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in text.SINGULARS.items()) + "}"
_SING = f"CASE WHEN {_MAP}[w] IS NOT NULL THEN {_MAP}[w] WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) END"


@query(f"SELECT doc_id, {_NORM.format('text')} AS normal, length({_NORM.format('text')}) AS n FROM documents")
def text_normalize(t: Tables) -> DataFrame:
    normal = text.normalize(F.col("text"))
    return t.documents.select("doc_id", normal.alias("normal"), F.length(normal).cast("long").alias("n"))


@query(
    f"""
    WITH n AS (SELECT p_partkey, {_NORM.format("p_type || ' ' || p_name || 's'")} AS v FROM part),
    l AS (SELECT *, regexp_extract(v, '([^ ]*)$', 1) AS w FROM n),
    s AS (SELECT *, {_SING} AS one FROM l)
    SELECT p_partkey, v AS normal, CASE WHEN one IS NULL THEN v ELSE v || '|' || regexp_replace(v, '[^ ]*$', '') || one END AS forms FROM s
    """
)
def text_variants(t: Tables) -> DataFrame:
    label = F.concat_ws(" ", "p_type", F.concat("p_name", F.lit("s")))
    return t.part.select("p_partkey", text.normalize(label).alias("normal"), F.array_join(text.variants(label), "|").alias("forms"))


@query(
    f"""
    WITH n AS (SELECT p_partkey, {_NORM.format("p_type || ' ' || p_name || 's'")} AS v FROM part),
    k AS (SELECT p_partkey, string_split(v, ' ') AS words, unnest(range(len(string_split(v, ' ')))) AS start FROM n WHERE v <> ''),
    p AS (SELECT p_partkey, start, array_to_string(words[start + 1:], ' ') AS phrase, words[len(words)] AS w FROM k),
    s AS (SELECT *, {_SING} AS one FROM p)
    SELECT p_partkey, start, phrase FROM s
    UNION ALL SELECT p_partkey, start, regexp_replace(phrase, '[^ ]*$', '') || one FROM s WHERE one IS NOT NULL
    """
)
def text_suffixes(t: Tables) -> DataFrame:
    label = F.concat_ws(" ", "p_type", F.concat("p_name", F.lit("s")))
    forms = t.part.select("p_partkey", F.explode(text.token_suffixes(label)).alias("f"))
    return forms.select("p_partkey", F.col("f.start").cast("long").alias("start"), F.col("f.phrase").alias("phrase"))


@query(
    """
    SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
           regexp_replace(lower(p_brand || ' - ' || p_type), '[\\s_-]+', '_', 'g') AS browse FROM part
    """
)
def text_slugs(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        text.slugify(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"),
        text.browse_key(F.concat_ws(" - ", "p_brand", "p_type")).alias("browse"),
    )


@query(
    """
    SELECT s_suppkey, 'gap:' || substr(sha1(s_name || '|' || s_nationkey), 1, 12) AS gap_id,
           'sim:' || substr(sha1(least(s_name, n_name) || '|' || greatest(s_name, n_name)), 1, 12) AS sim_id,
           'sha256:' || sha256(s_name) AS content
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """
)
def stable_ids(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        "s_suppkey",
        text.finding_id("gap", F.col("s_name"), F.col("s_nationkey").cast("string")).alias("gap_id"),
        text.finding_id("sim", F.col("s_name"), F.col("n_name"), ordered=False).alias("sim_id"),
        text.content_hash(F.col("s_name")).alias("content"),
    )


_PREFIXES = {"ex": "http://example.org/ex_", "part": "http://example.org/part/"}


@query(
    """
    WITH c AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'ex:' WHEN 1 THEN 'part:' ELSE 'no:' END || p_partkey AS curie FROM part)
    SELECT p_partkey, curie,
           CASE split_part(curie, ':', 1) WHEN 'ex' THEN 'http://example.org/ex_' || split_part(curie, ':', 2)
                WHEN 'part' THEN 'http://example.org/part/' || split_part(curie, ':', 2) END AS iri,
           CASE WHEN curie NOT LIKE 'no:%' THEN curie END AS back
    FROM c
    """
)
def curie_iri(t: Tables) -> DataFrame:
    prefix = F.when(F.col("p_size") % 3 == 0, "ex:").when(F.col("p_size") % 3 == 1, "part:").otherwise("no:")
    rows = t.part.select("p_partkey", F.concat(prefix, F.col("p_partkey").cast("string")).alias("curie"))
    rows = rows.withColumn("iri", text.iri(F.col("curie"), _PREFIXES))
    return rows.withColumn("back", text.curie(F.col("iri"), _PREFIXES))


@query(
    """
    SELECT p_partkey, p_name || ': ' || p_type AS term_text,
           p_name || ' ' || p_type || ' Also known as: ' || p_brand || ', ' || upper(p_name) || ', ' || lower(p_brand) AS ontology_text,
           CASE WHEN length(p_type || p_name) > 20 THEN left(p_type || p_name, 20) || '...' ELSE p_type || p_name END AS cut
    FROM part
    """
)
def embedding_texts(t: Tables) -> DataFrame:
    synonyms = F.array("p_brand", F.upper("p_name"), F.lower("p_brand"), F.lit("a fourth is not used"))
    return t.part.select(
        "p_partkey",
        text.term_text(F.col("p_name"), F.col("p_type")).alias("term_text"),
        text.ontology_text(F.col("p_name"), F.col("p_type"), synonyms).alias("ontology_text"),
        text.truncated(F.concat("p_type", "p_name"), 20).alias("cut"),
    )


@query(
    """
    WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
    SELECT event_type, n, round(100 * log10(n + 1) / log10(max(n) OVER () + 1), 6) AS width, round(100.0 * n / max(n) OVER (), 6) AS linear FROM c
    """
)
def frequency_bars(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    most = F.max("n").over(Window.partitionBy())
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select("event_type", "n", F.round(text.log_width(F.col("n"), most), 6).alias("width"), F.round(100.0 * F.col("n") / most, 6).alias("linear"))
