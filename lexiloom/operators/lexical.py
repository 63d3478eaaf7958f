"""Name matching: an inverted index of label forms, and the longest suffix of a query that meets it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import normalize, token_suffixes, variants
from lexiloom.operators.similarity import cosine, top_k
from lexiloom.session import durable


def index(terms: DataFrame) -> DataFrame:
    """variant, term_id, label, label_kind, row_no, label_no of terms (term_id, name, synonyms, row_no).

    Names come before synonyms; empty labels are skipped, but a label whose normal form is empty is not.
    """
    name = F.struct(F.col("name").alias("label"), F.lit("name").alias("kind"))
    others = F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.struct(s.alias("label"), F.lit("synonym").alias("kind")))
    labels = terms.select("term_id", "row_no", F.posexplode(F.concat(F.array(name), others)).alias("label_no", "l"))
    labels = labels.select("term_id", "row_no", "label_no", "l.label", F.col("l.kind").alias("label_kind")).where("label is not null and label <> ''")
    return labels.withColumn("variant", F.explode(variants(F.col("label")))).select("variant", "term_id", "label", "label_kind", "row_no", "label_no")


def search(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Hits of queries (query_id, text): term_id, label, label_kind, matched_on, match_kind, suffix_start, hit_no.

    A query's suffixes are tried from the longest on, each in its normal form and then in the singular; the first with
    any entry wins. A term counts once, by its first entry in the order of the index.
    """
    # written, the index is known to be small where it is, and is sent to the forms instead of these to it
    lexicon = durable(lexicon, "lexicon")
    forms = queries.select("query_id", F.posexplode(token_suffixes(F.col("text"))).alias("form_no", "form"))
    forms = forms.select("query_id", "form_no", F.col("form.phrase").alias("variant"), F.col("form.start").alias("suffix_start"))
    # which form wins is known before any term is fetched, so a common form costs its terms once for each query that it wins
    known = forms.join(lexicon.select("variant").distinct(), "variant", "left_semi")
    won = known.groupBy("query_id").agg(F.min(F.struct("form_no", "variant", "suffix_start")).alias("w")).select("query_id", "w.variant", "w.suffix_start")
    entry = F.min(F.struct("row_no", "label_no", "label", "label_kind", "variant", "suffix_start")).alias("e")
    hits = won.join(lexicon, "variant").groupBy("query_id", "term_id").agg(entry).select("query_id", "term_id", "e.*")
    order = Window.partitionBy("query_id").orderBy("row_no", "label_no", "term_id")
    kind = F.when(F.col("suffix_start") == 0, "lexical").otherwise("lexical-suffix")
    return hits.select("query_id", "term_id", "label", "label_kind", F.col("variant").alias("matched_on"), kind.alias("match_kind"), "suffix_start", F.row_number().over(order).alias("hit_no"))


def whole_name_matches(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Queries one of whose forms as a whole is in the index."""
    forms = queries.select("query_id", F.explode(variants(F.col("text"))).alias("variant"))
    return queries.join(forms.join(lexicon, "variant", "left_semi").select("query_id").distinct(), "query_id", "left_semi")


def any_matches(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Queries one of whose suffixes is in the index."""
    forms = queries.select("query_id", F.explode(token_suffixes(F.col("text"))).alias("form"))
    forms = forms.select("query_id", F.col("form.phrase").alias("variant"))
    return queries.join(forms.join(lexicon, "variant", "left_semi").select("query_id").distinct(), "query_id", "left_semi")


def is_known(text: str):
    """Filter for an index: the entries of one text's normal form."""
    return F.col("variant") == normalize(F.lit(text))


def blend(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Ranked candidates: lexical hits first, then the k best-scored terms that no hit named.

    hits: from search(); scores: (query_id, term_id, score). A hit's score is its term's, or 0.0 where there is none.
    Lexical hits do not use up the k.
    """
    lexical = hits.join(scores, ["query_id", "term_id"], "left").select(
        "query_id", "term_id", F.coalesce("score", F.lit(0.0)).alias("score"), "match_kind", F.lit(0).alias("tier"), F.col("hit_no").alias("ord")
    )
    rest = scores.join(hits.select("query_id", "term_id"), ["query_id", "term_id"], "left_anti")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "term_id"))
    rest = rest.withColumn("ord", best).where(F.col("ord") <= k)
    rest = rest.select("query_id", "term_id", "score", F.lit("embedding").alias("match_kind"), F.lit(1).alias("tier"), "ord")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "ord"))
    return lexical.unionByName(rest).select("query_id", rank.alias("rank"), "term_id", "score", "match_kind")


def blend_vectors(queries: DataFrame, lexicon: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Ranked candidates of queries (query_id, text, embedding), by names and by vectors together: see blend().

    targets: (term_id, row_no, embedding), one vector a term; row_no is the lexicon's. A hit's score is the cosine of the
    query and its term, 0.0 where either has no vector, or one of another length. So that k terms are left when the hits
    are taken out, the vector search keeps as many more as the query with the most hits has.
    """
    hits = durable(search(queries, lexicon), "hits")
    most = hits.groupBy("query_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    near = top_k(queries.select(F.col("query_id").alias("id"), "embedding"), targets.select(F.col("row_no").alias("id"), "embedding"), k + most)
    near = near.join(targets.select("term_id", F.col("row_no").alias("target_id")), "target_id").select("query_id", "term_id", F.col("similarity").alias("score"))
    vectors = queries.select("query_id", F.col("embedding").alias("q")), targets.select("term_id", F.col("embedding").alias("t"))
    pairs = hits.select("query_id", "term_id").join(vectors[0], "query_id").join(vectors[1], "term_id").where(F.size("q") == F.size("t"))
    pairs = pairs.select("query_id", "term_id", cosine(F.col("q"), F.col("t")).alias("score"))
    return blend(hits, near.join(pairs, ["query_id", "term_id"], "left_anti").unionByName(pairs), k)


def candidates_of(queries: DataFrame, blended: DataFrame, name: str) -> DataFrame:
    """The candidates of the one query whose text is `name`; an unknown name is an error."""
    one = queries.where(F.col("text") == name)
    if one.isEmpty():
        raise KeyError(name)
    return blended.join(one, "query_id", "left_semi")
