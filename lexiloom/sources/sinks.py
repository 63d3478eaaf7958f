"""Writers: reports as JSON and Markdown lines, candidate tables, statements, embedding tables, generated sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import truncated


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """Text lines (value) in the given order: ranges of the order are written side by side, a file for each."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def report_json(rows: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """value: a JSON line for each row, each with where it comes from."""
    source = F.struct(*(F.lit(v).alias(k) for k, v in provenance.items())).alias("provenance")
    return rows.select(F.to_json(F.struct(source, *rows.columns)).alias("value"))


# The columns of a candidate table, in order, after the term's own.
CANDIDATE_COLUMNS = ("category", "subset", "existing_mapping", "rank", "match_kind", "match_id", "match_label", "matched_on", "score", "match_def")


def candidates_written(rows: DataFrame, term: str) -> DataFrame:
    """Candidates (term and CANDIDATE_COLUMNS) as they are written: empty for null, score to 3 places, definition to 300 characters."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    shown = {"score": F.format_string("%.3f", F.col("score")), "match_def": F.substring(text("match_def"), 1, 300)}
    return rows.select(text(term).alias(term), *(shown.get(c, text(c)).alias(c) for c in CANDIDATE_COLUMNS))


def write_report(head: DataFrame, rows: DataFrame, path: str, provenance: dict[str, str], *order: str) -> None:
    """A report as two sets of JSON lines: its totals (a row) with where they come from, and its records in order.

    Records are written in ranges side by side, so a report of any size passes through no single task.
    """
    report_json(head, provenance).write.mode("overwrite").text(f"{path}/head")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(f"{path}/records")


def read_written_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The head and the records of a report that write_report() wrote."""
    return spark.read.json(f"{path}/head"), spark.read.json(f"{path}/records")


def pair_markdown(pairs: DataFrame) -> DataFrame:
    """c, n, value: Markdown lines of similar pairs (term1, term2, category1, category2, similarity, crosses, recommendation).

    First a table of all pairs, nearest first, then a list of those across categories; sort by c and n.
    """
    names = F.concat(F.col("category1"), F.lit("/"), F.col("category2"))
    shown = F.when(F.col("crosses"), F.concat(F.lit("**"), names, F.lit("**"))).otherwise(names)
    place = F.struct((-F.col("similarity")).alias("s"), "term1", "term2").alias("n")
    none = F.lit(None).cast("struct<s: double, term1: string, term2: string>").alias("n")
    table = pairs.select(F.lit(1).alias("c"), place, F.format_string("| %s | %s | %.2f | %s | %s |", "term1", "term2", "similarity", shown, "recommendation").alias("value"))
    listed = pairs.where("crosses").select(F.lit(3).alias("c"), place, F.format_string("- **%s** (%s) <-> **%s** (%s): %.2f", "term1", "category1", "term2", "category2", "similarity").alias("value"))
    heads = pairs.agg(F.count_if("crosses").alias("k")).select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("c"), F.lit("| Term 1 | Term 2 | Similarity | Categories | Recommendation |\n|---|---|---|---|---|").alias("value")),
                F.struct(F.lit(2).alias("c"), F.when(F.col("k") > 0, "## Across categories").otherwise("No pairs across categories.").alias("value")),
            )
        ).alias("h")
    )
    return heads.select("h.c", none, "h.value").unionByName(table).unionByName(listed)


def gap_markdown(gaps: DataFrame) -> DataFrame:
    """s, level, n, value: Markdown lines of gap terms (subset, name, definition, max_similarity, best, ontology), by subset.

    In a subset the worst matched term comes first, with its definition to 100 characters and its best match, if any.
    """
    rows = gaps.withColumn("s", F.coalesce(F.nullif("subset", F.lit("")), F.lit("other")))
    none = F.lit(None).cast("struct<m: double, name: string>")
    heads = rows.groupBy("s").agg(F.count("*").alias("k"), F.max("max_similarity").alias("m"))
    heads = heads.select("s", F.lit(0).alias("level"), none.alias("n"), F.format_string("### %s (%d terms, max sim: %.2f)", F.col("s"), F.col("k"), F.col("m")).alias("value"))
    text = F.coalesce("definition", F.lit(""))
    lines = F.array_compact(
        F.array(
            F.format_string("- **%s** (max sim: %.2f)", "name", "max_similarity"), F.when(text != "", F.concat(F.lit("  - Definition: "), truncated(text, 100))),
            F.when(F.col("best").isNotNull(), F.format_string("  - Best match: %s (%s, %.2f)", F.col("best"), F.col("ontology"), F.col("max_similarity"))),
        )
    )
    items = rows.select("s", F.lit(1).alias("level"), F.struct(F.col("max_similarity").alias("m"), "name").alias("n"), F.array_join(lines, "\n").alias("value"))
    return heads.unionByName(items)


def candidate_table(rows: DataFrame) -> DataFrame:
    """Candidate rows (with score and definition) as they are written: score to 3 places, definition to 300 characters."""
    return rows.withColumn("score", F.format_string("%.3f", F.col("score"))).withColumn("definition", F.substring("definition", 1, 300))


def write_tsv(rows: DataFrame, path: str, *order: str) -> None:
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    out.write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def frequency_table(counts: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(term, count) by falling count and name; with seeds, every seed with a yes or no and zeros, by name."""
    if seeds is None:
        return counts.orderBy(F.col("count").desc(), "term")
    found = F.when(F.col("count").isNotNull(), "yes").otherwise("no")
    return seeds.join(counts, "term", "left").select("term", found.alias("found"), F.coalesce("count", F.lit(0)).alias("count")).orderBy("term")


def report_markdown(rows: DataFrame) -> DataFrame:
    """section, ord, value: Markdown of rows (category, subset, name, definition, best, score), grouped by category and
    subset; names are cut to 30 characters, definitions to 100, scores to 2 places."""
    category, subset = F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized")), F.coalesce(F.nullif("subset", F.lit("")), F.lit("other"))
    rows = rows.withColumn("c", category).withColumn("s", subset)
    line = lambda df, level, c, s, n, value: df.select(c.alias("c"), s.alias("s"), F.lit(level).alias("level"), n.alias("n"), value.alias("value"))
    none = F.lit("")
    groups = rows.groupBy("c", "s").agg(F.count("*").alias("k"), F.max("score").alias("m"))
    heads = line(groups.select("c").distinct(), 0, F.col("c"), none, none, F.concat(F.lit("## "), "c"))
    subs = line(groups, 1, F.col("c"), F.col("s"), none, F.format_string("### %s (%d terms, max %.2f)", F.col("s"), F.col("k"), F.col("m")))
    item = F.format_string("- **%s** %s (%.2f): %s", F.substring("name", 1, 30), F.coalesce("best", F.lit("-")), F.col("score"), truncated(F.coalesce("definition", F.lit("")), 100))
    items = line(rows, 2, F.col("c"), F.col("s"), F.col("name"), item)
    return heads.union(subs).union(items).select("c", "s", "level", "n", "value")


def write_embeddings(rows: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """Vectors beside their metadata, and where they come from as a table of its own."""
    rows.write.mode("overwrite").parquet(f"{path}/vectors")
    rows.sparkSession.createDataFrame(sorted(provenance.items()), "key string, value string").write.mode("overwrite").parquet(f"{path}/provenance")


def read_embeddings(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The vectors; those of another model than asked for are an error."""
    made = spark.read.parquet(f"{path}/provenance").where("key = 'model_name'").first()
    if model is not None and (made is None or made["value"] != model):
        raise ValueError(f"vectors are of {made and made['value']}, not of {model}")
    return spark.read.parquet(f"{path}/vectors")


def read_stores(spark: SparkSession, root: str, own: str, model: str | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """The vectors of every store under root but the vocabulary's own, with `ontology`, the store's name, and `provenance`, a map.

    With `only`, just the stores of these names are opened; a name that is not there is an error.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = sorted(s.getPath().getName() for s in listed if s.isDirectory() and s.getPath().getName() != own)
    if only is not None:
        if missing := sorted(set(only) - set(names)):
            raise FileNotFoundError(f"no store {', '.join(missing)} under {root}")
        names = sorted(only)
    if not names:
        raise FileNotFoundError(f"no other store under {root}")

    def opened(name: str) -> DataFrame:
        said = spark.read.parquet(f"{root}/{name}/provenance").collect()  # a handful of keys
        pairs = [F.lit(x) for r in said for x in (r["key"], r["value"])]
        origin = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return read_embeddings(spark, f"{root}/{name}", model).withColumns({"ontology": F.lit(name), "provenance": origin})

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(opened, names))


def between_marks(text: Column, begin: str, end: str, new: Column) -> Column:
    """text with what stands between two marks replaced, or both marks and the new part added at its end."""
    has = F.contains(text, F.lit(begin)) & F.contains(text, F.lit(end))
    head, tail = F.substring_index(text, begin, 1), F.substring_index(text, end, -1)
    block = F.concat(F.lit(f"{begin}\n"), new, F.lit(f"\n{end}"))
    return F.when(has, F.concat(head, block, tail)).otherwise(F.concat(text, F.lit("\n"), block, F.lit("\n")))


def envelope(total: Column, size: int = 100_000) -> Column:
    """The paging head of a list that comes as one page."""
    return F.struct(F.lit(0).alias("page"), F.lit(size).alias("page_size"), total.alias("total"), F.lit(1).alias("total_pages"))


def document(kind: str, rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """kind, key and body of a document a row: JSON text of the columns, its fields sorted by name."""
    body = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns))), {"ignoreNullFields": "false"})
    return rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), body.alias("body"))


def children(rows: DataFrame, parent: str, name: str, order: str, *columns: str) -> DataFrame:
    """parent and a list of its rows in this order, each a struct of the columns, its fields sorted by name: a level of a document."""
    item = F.struct(F.col(order).alias("_o"), F.struct(*(F.col(f"`{c}`") for c in sorted(columns))).alias("_v"))
    return rows.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["_v"]).alias(name))


def write_documents(documents: list[DataFrame], path: str) -> None:
    """Write documents (kind, key, body) of several kinds in one job: a folder a kind, JSON lines {"key", "body"} in the keys' order.

    Documents are dealt by ranges of kind and key, so a large kind takes many files and a small one few. A kind and key that
    come twice are an error, and then nothing is written.
    """
    rows = reduce(DataFrame.unionByName, documents)
    again = rows.groupBy("kind", "key").count().where("count > 1").first()
    if again:
        raise ValueError(f"{again['kind']} {again['key']}: more than one document")
    rows.repartitionByRange("kind", "key").sortWithinPartitions("kind", "key").write.partitionBy("kind").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """kind, key, body of what write_documents wrote."""
    return spark.read.schema("key string, body string, kind string").json(path).select("kind", "key", "body")
