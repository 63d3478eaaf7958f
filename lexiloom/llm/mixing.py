"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import WORD, durable, unused

#: Slots of a chunk, and documents of a shuffle bucket: what one window holds.
CHUNK, BUCKET = 1 << 16, 8192
#: Points lie on a grid of 2**31; the step is the odd number next to 2**31 over the golden ratio.
GRID, STEP = 1 << 31, 1327217885


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, src (a key without nulls), size in words, and the order of the seeded shuffle."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~")).alias("src")
    order = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("ord")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return docs.select("doc_id", "source", key, size, order, F.xxhash64("text").alias("text_hash"))


def targets(base: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """A row per source: src, source_size, docs, target (double), quota (whole words).

    Sources in order of code points, null last, take the weights in turn and share `share` times all words; a source
    stops at `most` times its own words, and what it leaves goes to the others by weight. The windows here run over
    one row per source.
    """
    per = base.groupBy("src", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    line = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    onward = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (F.lit(share) * total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level).withColumn("at", F.row_number().over(line))
    per = per.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    rest = F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * rest).alias("target")
    return per.select("src", "source", "source_size", "docs", target).withColumn(
        "quota", F.least(F.floor(F.col("target") + 0.5), F.lit(most) * F.col("source_size"))
    )


def placed(base: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document's place `at` in its source's shuffled line of words.

    A source's line is cut by the shuffle's order into buckets of about BUCKET documents. Places are counted inside
    buckets, then bucket totals are summed, so a source of any size is spread over many tasks.
    """
    sources = sources.select("src", "source_size", "docs", "quota")
    part = F.conv(F.substring("ord", 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))
    docs = base.join(sources, "src").withColumn("bucket", F.floor(part * F.ceil(F.col("docs") / BUCKET)))
    inside = Window.partitionBy("src", "bucket").orderBy("ord", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = docs.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    buckets = buckets.select("src", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    return docs.join(buckets, ["src", "bucket"]).withColumn("at", F.col("ahead") + F.col("inside"))


def point(slot: Column) -> Column:
    """The golden-ratio sequence in whole numbers: slot to its point on the grid, without rounding."""
    return F.pmod(F.pmod(slot, F.lit(GRID)) * F.lit(STEP), F.lit(GRID))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(src, block_no, slot): the slot of every block of every source.

    A slot's point falls in the interval of one source; intervals are as long as the sources' shares of blocks, and
    the k-th slot of a source takes its block k; a slot past a source's last block stays empty. The few blocks that no
    point reached, for the points are not quite even, take the slots after the last, source by source. Points meet
    intervals by an equality join on cells of the grid. Ranks are counted inside chunks of slots and summed over chunks.
    """
    spark = sources.sparkSession
    shares = sources.select("src", F.ceil(F.col("quota") / block).alias("blocks")).where("blocks > 0")
    slots, kinds = shares.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count("*")).first()
    ahead = F.coalesce(F.sum("blocks").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = 1 << max(10, math.ceil(math.log2(4 * kinds + 1)))
    wide = GRID // cells
    edge = lambda c: F.floor(c.cast("double") / max(slots, 1) * GRID)
    spans = shares.withColumn("ahead", ahead).select("src", "blocks", edge(F.col("ahead")).alias("lo"), edge(F.col("ahead") + F.col("blocks")).alias("hi"))
    spans = spans.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {wide}"), F.expr(f"(hi - 1) div {wide}"))))
    line = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("x"))
    line = line.withColumn("cell", F.expr(f"x div {wide}")).join(spans, "cell").where("x >= lo and x < hi")
    line = line.select("src", "blocks", "slot", F.expr(f"slot div {CHUNK}").alias("chunk"))
    ahead = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = line.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    chunks = chunks.select("src", "chunk", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    line = line.withColumn("rank", rank).join(chunks.drop("n"), ["src", "chunk"])
    line = line.select("src", (F.col("ahead") + F.col("rank")).alias("block_no"), "slot", "blocks").where("block_no < blocks").drop("blocks")
    reached = chunks.groupBy("src").agg(F.max(F.col("ahead") + F.col("n")).alias("reached"))
    late = shares.join(reached, "src", "left").withColumn("reached", F.least(F.coalesce("reached", F.lit(0)), "blocks")).withColumn("late", F.col("blocks") - F.col("reached")).where("late > 0")
    late = late.withColumn("ahead", F.coalesce(F.sum("late").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    late = late.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("late") - 1)))
    return line.unionByName(late.select("src", (F.col("reached") + F.col("k")).alias("block_no"), (F.lit(slots) + F.col("ahead") + F.col("k")).alias("slot")))


def _passes(docs: DataFrame, most: int) -> DataFrame:
    """Each document once for every pass over its source's line that reaches it."""
    docs = docs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    docs = docs.withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("at"))
    return docs.withColumn("stop", F.least(F.col("begin") + F.col("size"), F.col("quota")))


def mix(base: DataFrame, sources: DataFrame, block: int = 1024, most: int = 2) -> DataFrame:
    """The mix as pieces of documents: rid, doc_id, source, epoch, start_word, words, and order (slot, then start).

    base: from sized(), with a row id `rid`; sources: from targets(). A source's line of shuffled documents, repeated
    up to `most` times and ended at its quota, is cut into blocks of `block` words; the last may be shorter. The mix is
    what the slots of schedule() take, walked in order.
    """
    pieces = _passes(placed(base, sources), most).where("stop > begin")
    pieces = pieces.withColumn("block_no", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(stop - 1) div {block}"))))
    start = F.greatest("begin", F.col("block_no") * block)
    words = F.least(F.col("stop"), (F.col("block_no") + 1) * block) - start
    pieces = pieces.select("rid", "doc_id", "source", "src", "epoch", "block_no", (start - F.col("begin")).alias("start_word"), words.alias("words"), start.alias("place"))
    out = pieces.join(schedule(sources, block), ["src", "block_no"])
    return out.select("rid", "doc_id", "source", "epoch", "start_word", "words", "slot", "block_no", "place")


def prepare(docs: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The sized documents with row ids, and the sources, both written once: texts are read once."""
    base = durable(sized(docs).withColumn("rid", F.monotonically_increasing_id()), "sized")
    return base, durable(targets(base, weights, share, most), "sources")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 1024) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words that the schedule's slots take, repeats counted), first_slot.

    first_slot is null where nothing is taken. A null source is a source of its own; a null text has size 0 and takes
    nothing; equal rows are mixed one by one; an empty table gives an empty table; other columns are not read.
    """
    base, sources = prepare(docs, weights, share, most)
    taken = mix(base, sources, block, most).groupBy("rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = base.join(sources.select("src", "source_size", "target"), "src").join(taken, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 1024) -> DataFrame:
    """The rows of docs that the mix takes, in whole documents and the schedule's order: none, one or up to `most` copies of each.

    A copy is taken where a piece of mix() begins its document, so a source's words differ from its target by less than
    one document, and stands where that piece's slot stands, so sources interleave. Documents without words take no
    share and stay once, after the others. Rows that repeat a doc_id with the same text share the largest number of
    copies. A null source is a source of its own; an empty table gives an empty table. All columns are returned,
    whatever their names.
    """
    out, slot, place = scheduled(docs, weights, share, most, block)
    return out.orderBy(F.col(slot).asc_nulls_last(), place).select(*(f"`{c}`" for c in docs.columns))


def scheduled(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 1024) -> tuple[DataFrame, str, str]:
    """The rows of mixed_documents() in any order; the names of two more columns: slot (null: after all), place in the source's line."""
    base, sources = prepare(docs, weights, share, most)
    begun = mix(base, sources, block, most).where("start_word = 0").select("rid", F.struct("slot", "place").alias("at"))
    begun = begun.unionByName(base.where("size = 0").select("rid", F.struct(F.lit(None).cast("long").alias("slot"), F.lit(None).cast("long").alias("place")).alias("at")))
    copies = begun.groupBy("rid").agg(F.sort_array(F.collect_list("at")).alias("at"))
    copies = base.select("rid", "doc_id", "text_hash").join(copies, "rid")
    copies = copies.groupBy("doc_id", "text_hash").agg(F.max_by("at", F.struct(F.size("at"), "rid")).alias("at"))
    of, text_hash, at, slot, place = (unused(docs, n) for n in ("of", "text_hash", "at", "slot", "place"))
    copies = copies.select(F.col("doc_id").alias(of), F.col("text_hash").alias(text_hash), F.col("at").alias(at))
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(text_hash))
    out = docs.join(durable(copies, "copies"), same).withColumn(at, F.explode(at))
    return out.select(*(f"`{c}`" for c in docs.columns), F.col(at)["slot"].alias(slot), F.col(at)["place"].alias(place)), slot, place
