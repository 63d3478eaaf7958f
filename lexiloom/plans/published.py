"""Versions of a registry and an incremental rebuild, over documents that Spark makes of parts and line items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.registry import Tables, query
from lexiloom.session import keep_until_end, shared_dir
from lexiloom.sources import publish, sinks


def _root(t: Tables, name: str) -> str:
    """A folder of this run's own."""
    path = f"{shared_dir(t.spark).rstrip('/')}/lexiloom/{name}-{uuid.uuid4().hex}"
    keep_until_end(t.spark, path)
    return path


@query(
    """
    WITH d AS (SELECT p_partkey, octet_length(encode(p_name || '|' || p_brand || '|' || p_type)) AS n FROM part)
    SELECT '0.2.1' AS version, 1 AS place, 'superseded' AS status, count(*) AS documents, CAST(sum(n) AS BIGINT) AS bytes FROM d WHERE p_partkey % 2 = 0
    UNION ALL SELECT '0.9.0', 2, 'superseded', count(*), CAST(sum(n) AS BIGINT) FROM d WHERE p_partkey % 3 = 0
    UNION ALL SELECT '0.10.0', 3, 'current', count(*), CAST(sum(n) AS BIGINT) FROM d
    """
)
def registry_versions(t: Tables) -> DataFrame:
    """Three versions, published out of order and the first of them twice."""
    root = _root(t, "registry")
    rows = t.part.select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.concat_ws("|", "p_name", "p_brand", "p_type").alias("body"))
    for version, which in (("0.9.0", "true"), ("0.9.0", "p_partkey % 3 = 0"), ("0.2.1", "p_partkey % 2 = 0"), ("0.10.0", "true")):
        publish.publish(rows.where(which), root, version)
    return publish.version_list(t.spark, root)


@query(
    """
    WITH p AS (SELECT p_brand AS part, count(*) AS n, count(*) FILTER (p_size = 7) AS odd, min(p_partkey) AS first FROM part GROUP BY 1)
    SELECT part, CASE WHEN first % 5 = 0 THEN 'missing' WHEN first % 7 = 0 THEN 'removed' WHEN odd > 0 THEN 'changed' END AS reason, CASE WHEN first % 5 = 0 OR first % 7 > 0 THEN CASE WHEN first % 5 <> 0 AND odd = 0 THEN 'first' ELSE 'second' END END AS built,
           CASE WHEN first % 5 = 0 OR first % 7 > 0 THEN n ELSE 0 END AS rows
    FROM p
    """
)
def rebuilt_parts(t: Tables) -> DataFrame:
    """Brands as parts: built once without every fifth, then again when sizes of 7 are another number and every seventh is gone."""
    root, spark = _root(t, "rebuilt"), t.spark
    first = t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    rows = t.part.join(first, "p_brand").select(F.col("p_brand").alias("part"), "p_partkey", "p_size", "first")

    def sources(found: DataFrame) -> DataFrame:
        line = F.sum(F.xxhash64("p_partkey", "p_size").cast("decimal(20,0)")).cast("string")
        return found.groupBy("part").agg(F.sha2(line, 256).alias("hash"))

    def built(found: DataFrame, name: str):
        return lambda todo: found.join(todo.select("part"), "part").select("part", "p_partkey", "p_size", F.lit(name).alias("run"))

    before, after = rows.where("first % 5 <> 0"), rows.where("first % 5 = 0 or first % 7 <> 0").withColumn("p_size", F.when(F.col("p_size") == 7, 70).otherwise(F.col("p_size")))
    publish.refresh(spark, root, sources(before), built(before, "first"))
    plan = publish.refresh(spark, root, sources(after), built(after, "second"))
    if publish.refresh(spark, root, sources(after), built(after, "third")).where("reason is not null").count():
        raise AssertionError("what is current was rebuilt")
    now = publish.current_rows(spark, root).groupBy("part").agg(F.max("run").alias("built"), F.count("*").alias("rows"))
    reason = F.when(F.col("reason").startswith("hash changed"), "changed").otherwise(F.col("reason"))
    return plan.select("part", reason.alias("reason")).join(now, "part", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


@query(
    """
    WITH l AS (SELECT l_orderkey, list(struct_pack(line := l_linenumber, part := 'p' || l_partkey) ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1),
    o AS (SELECT o_custkey, list(struct_pack(lines := coalesce(lines, []), number := o_orderkey, status := o_orderstatus) ORDER BY o_orderkey) AS orders FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1),
    b AS (SELECT p_type, p_brand, list(p_partkey ORDER BY p_partkey) AS parts FROM part GROUP BY ALL)
    SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS key, CAST(to_json(struct_pack(name := c_name, orders := coalesce(orders, []), segment := c_mktsegment)) AS VARCHAR) AS body FROM customer LEFT JOIN o ON c_custkey = o_custkey
    UNION ALL SELECT 'brand', p_type || '/' || p_brand, CAST(to_json(struct_pack(brand := p_brand, parts := parts, type := p_type)) AS VARCHAR) FROM b
    """
)
def site_documents(t: Tables) -> DataFrame:
    """Customers with their orders and those with their lines, and brands with their parts: written in one job, then read back."""
    lines = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("line"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("part"), F.struct("l_linenumber", "l_partkey").alias("at"))
    lines = sinks.children(lines, "l_orderkey", "lines", "at", "line", "part")
    orders = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("status"), F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"))
    orders = sinks.children(orders, "o_custkey", "orders", "number", "number", "status", "lines")
    customers = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    customers = customers.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.coalesce("orders", F.array().cast(orders.schema["orders"].dataType)).alias("orders"))
    brands = t.part.groupBy(F.col("p_type").alias("type"), F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_list("p_partkey")).alias("parts")).withColumn("key", F.concat_ws("/", "type", "brand"))
    path = _root(t, "documents")
    sinks.write_documents([sinks.document("customer", customers, "c_custkey", "name", "segment", "orders"), sinks.document("brand", brands, "key", "type", "brand", "parts")], path)
    return sinks.read_documents(t.spark, path)
