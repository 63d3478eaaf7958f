"""Training order written down: a keyed permutation gives every sequence a slot, shards of fixed stride hold slots in order."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import durable, shared_dir
from lexiloom.llm.packing import token_pieces
from lexiloom.session import keep_until_end

_U = np.uint64


def _round(x: np.ndarray, key: int, number: int) -> np.ndarray:
    x = x ^ _U((key + number * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def permute(numbers: np.ndarray, n: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """A keyed bijection of 0 .. n - 1, or its inverse.

    A Feistel network permutes the next even power of two; values that fall outside are sent through again until they
    do not (cycle-walking), which takes under four turns on average and keeps it a bijection.
    """
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask, shift = _U((1 << half) - 1), _U(half)
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(rounds - 1, -1, -1) if back else range(rounds):
            if back:
                left, right = right ^ (_round(left, key, r) & mask), left
            else:
                left, right = right, left ^ (_round(right, key, r) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots(sequences: DataFrame, n: int, key: int) -> DataFrame:
    """Adds slot to rows with a dense `number` of 0 .. n - 1."""

    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, key))

    return sequences.withColumn("slot", slot("number"))


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows, written once, with a dense number in the order of writing, and how many there are.

    Offsets are a row for each task that wrote, which bounds what is broadcast.
    """
    rows = durable(rows.withColumn("_at", F.monotonically_increasing_id()), "sequences", "zstd")
    task = F.shiftright("_at", 33)
    sizes = rows.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_ahead", F.coalesce(ahead, F.lit(0)))
    out = rows.join(F.broadcast(sizes), task == F.col("_task"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("number", F.col("_ahead") + place).drop("_at", "_task", "_n", "_ahead"), rows.count()


#: A shard: its slots in order, each a record of `stride` bytes: a length, then ids of 16 bits, zeros to the end.
SHARD = "shard long, first_slot long, records int, stride int, payload binary, doc_ids array<long>, pieces array<int>"


def _shards(size: int, per_shard: int):
    stride = 4 + 2 * size

    def close(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        records = np.zeros((len(rows), stride), np.uint8)
        for k, (_, _, ids) in enumerate(rows):
            records[k, :4] = np.frombuffer(np.array([len(ids) // 2], "<u4").tobytes(), np.uint8)
            records[k, 4 : 4 + len(ids)] = np.frombuffer(ids, np.uint8)
        columns = ([shard], pa.int64()), ([shard * per_shard], pa.int64()), ([len(rows)], pa.int32()), ([stride], pa.int32()), ([records.tobytes()], pa.binary())
        lists = ([[r[0] for r in rows]], pa.list_(pa.int64())), ([[r[1] for r in rows]], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(*c) for c in (*columns, *lists)], names=["shard", "first_slot", "records", "stride", "payload", "doc_ids", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and shard != now:
                    yield close(now, rows)
                    rows = []
                now = shard
                rows.append(row)
        if rows:
            yield close(now, rows)

    return run


def materialise(docs: DataFrame, path: str, tokenizer: str, size: int = 1024, per_shard: int = 1024, key: int = 20_240_601) -> None:
    """Write docs' whole texts as token sequences in training order: a Parquet table of shards (see SHARD) at path.

    A text's ids are cut into sequences of `size`, each ended by id 1 where the text ends. Sequences are numbered in the
    order in which the scan splits docs (the same files, split size and key give the same order again), permuted by the key, and dealt by ranges of slots, so every shard but the last is full and every file
    holds shards in order. A null text is an empty one; a null doc_id stays null; repeated rows give sequences of
    their own; without documents there are no shards. Ids must be below 65,536.
    """
    pieces = token_pieces(docs.withColumn("doc_id", F.col("doc_id").cast("long")), tokenizer, size, id_bits=16).select("doc_id", "piece", "ids")
    rows, n = numbered(pieces)
    count = max(1, math.ceil(n / per_shard))
    parts = max(1, min(count, math.ceil(count * per_shard * (4 + 2 * size) / (32 << 20))))
    rows = slots(rows, max(n, 1), key).withColumn("shard", F.expr(f"slot div {per_shard}"))
    dealt = rows.repartitionById(parts, F.expr(f"shard * {parts} div {count}").cast("int")).sortWithinPartitions("slot")
    dealt.select("shard", "doc_id", "piece", "ids").mapInArrow(_shards(size, per_shard), SHARD).write.option("compression", "zstd").parquet(path)


def _reader(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                n = row["records"]
                records = np.frombuffer(row["payload"], np.uint8).reshape(n, row["stride"])
                lengths = records[:, :4].copy().view("<u4")[:, 0].astype(np.int64)
                ids = (r[4 : 4 + 2 * m].tobytes() for r, m in zip(records, lengths, strict=True))
                last = pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids], pa.int64()) if digest else pa.array(list(ids), pa.binary())
                columns = pa.array(range(row["first_slot"], row["first_slot"] + n), pa.int64()), pa.array([row["shard"]] * n, pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["pieces"], pa.int32()), pa.array(lengths), last
                yield pa.RecordBatch.from_arrays(list(columns), names=["slot", "shard", "doc_id", "piece", "length", "ids_crc32" if digest else "ids"])

    return run


def read_order(spark: SparkSession, path: str, first_slot: int = 0, digest: bool = False) -> DataFrame:
    """slot, shard, doc_id, piece, length, ids (or ids_crc32, as of 32-bit ids) from a slot on.

    Shards before the one that holds the slot are left out by a comparison that reaches the scan, so row groups of
    earlier shards are skipped.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    if first_slot > 0:
        most = shards.agg(F.coalesce(F.max("records"), F.lit(0))).first()[0]
        shards = shards.where(F.col("first_slot") > first_slot - most)
    last = "ids_crc32 long" if digest else "ids binary"
    out = shards.mapInArrow(_reader(digest), f"slot long, shard long, doc_id long, piece int, length long, {last}")
    return out.where(F.col("slot") >= first_slot)


def token_order(docs: DataFrame, tokenizer: str, size: int = 1024) -> DataFrame:
    """Materialise docs in the shared folder and read them back: slot, shard, doc_id, piece, length, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexiloom/order-{uuid.uuid4().hex}"
    materialise(docs, path, tokenizer, size)
    keep_until_end(spark, path)
    return read_order(spark, path, digest=True)
