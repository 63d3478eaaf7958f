"""Words and connected components, and what the operators share with the rest of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.session import durable, shared_dir, unused

__all__ = ["WORD", "connected_components", "durable", "shared_dir", "sift", "unused"]

#: A word is a longest run of anything but space and the five ASCII control characters tab to return.
WORD = r"[^\x20\x09-\x0D]+"


#: Bits of the largest map that sift() broadcasts: 8 MB.
MOST_BITS = 1 << 26


def sift(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows into those whose key may be among wanted's and those whose key is not, without moving any.

    Keys are hashes (long). A map of bits, 64 for each wanted key but never more than MOST_BITS, is broadcast; where keys
    outgrow it, more rows may seem to be wanted, and no wanted one is missed. The first part is for a join that decides.
    """
    bits = min(MOST_BITS, 1 << max(15, (64 * wanted.count()).bit_length()))
    place = lambda k: F.pmod(k, F.lit(bits)) + 1
    number, bitmap = unused(rows, "bucket"), unused(rows, "bitmap")
    maps = wanted.select(F.bitmap_bucket_number(place(wanted_key)).alias(number), F.bitmap_bit_position(place(wanted_key)).alias("at"))
    maps = maps.groupBy(number).agg(F.bitmap_construct_agg("at").alias(bitmap))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    found = rows.withColumn(number, F.bitmap_bucket_number(place(key))).join(F.broadcast(maps), number, "left")
    return found.where(is_set).drop(number, bitmap), found.where(~is_set).drop(number, bitmap)


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Components of an undirected graph of long ids: (node, component = the smallest id reachable).

    Alternating large-star and small-star rounds, each a few joins and partial aggregations on the edges alone, so
    that a hub or a long chain neither lands in one task nor takes a round per link; the state after each round is a
    written table. Self-links, repeated links and links with a null end are ignored; nodes without a link do not
    appear.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    now = durable(now.distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v"), F.col("v")).distinct()
    )
