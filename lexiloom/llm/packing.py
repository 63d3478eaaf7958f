"""Best-fit packing with certified lower bounds."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lexiloom.llm.common import durable
from lexiloom.llm.tokens import word_tokens


def _stored(ids: bytes, bits: int) -> bytes:
    if bits == 32:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if wide.max(initial=0) >> bits:
        raise ValueError(f"an id takes more than {bits} bits")
    return wide.astype(f"<u{bits // 8}").tobytes()


def _pieces(column: pa.Array, path: str, size: int, end: bytes, bits: int | None) -> dict[str, list]:
    out: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
    texts = column.cast(pa.binary()).fill_null(b"").to_pylist()
    for row, ids in enumerate(word_tokens(path).encode(texts)):
        ids += end
        for piece, at in enumerate(range(0, len(ids), 4 * size)):
            part = ids[at : at + 4 * size]
            for name, value in zip(out, (row, piece, at // 4, len(part) // 4, zlib.crc32(part), _stored(part, bits) if bits else None), strict=True):
                out[name].append(value)
    return out


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 1, id_bits: int | None = None) -> DataFrame:
    """Cut each whole text's ids, then end_id, into pieces of `size` ids; a text's last piece may be shorter.

    Returns doc_id, piece (from 0), start, length, ids_crc32 and, if asked for, ids (binary, little-endian, unsigned,
    16 or 32 bits). A null text is empty and gives one piece of one id; repeated rows each give their pieces; other columns
    are not read.
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType
    fields = [StructField("doc_id", id_type), StructField("piece", IntegerType()), *(StructField(n, LongType()) for n in ("start", "length", "ids_crc32"))]
    schema = StructType(fields)
    if id_bits:
        schema = schema.add("ids", "binary")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                out = _pieces(some.column(1), tokenizer, size, end, id_bits)
                columns = [some.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32"))]
                if id_bits:
                    columns.append(pa.array(out["ids"], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(cut, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. Longest first, into the fullest bin with room."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: some open bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room > length:
            by_room[room - length].append(b)
            rooms |= 1 << (room - length)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing of these lengths can go below; see bound_of_counts."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1)) if len(lengths) else 0


def bound_of_counts(count: np.ndarray) -> int:
    """A number of bins that no packing can go below: the best of three families of dual feasible functions.

    A dual feasible function maps lengths so that whatever fits one bin still sums to one bin at most; the mapped sum,
    rounded up, is then a bound. Taken are the identity, the threshold functions (over capacity - e counts as a
    whole bin, under e as nothing) and the rounding functions of k = 1 to 20. count: how often each length from 0 to
    the capacity occurs.
    """
    count, capacity = count.astype(np.int64), len(count) - 1
    size = np.arange(capacity + 1, dtype=np.int64)
    n_to, sum_to = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(sum_to[-1]) // capacity)
    e = np.arange(1, capacity // 2 + 1)
    whole = n_to[-1] - n_to[capacity - e]
    middle = sum_to[capacity - e] - sum_to[e - 1]
    best = max(best, int((whole + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 21):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        # in units of capacity * k, so that all stays whole
        mapped = np.where(exact, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((mapped * count).sum()) // (capacity * k)))
    return best


def _pack_part(rows: pa.Table, capacity: int, turn: int, last: bool) -> pa.Table:
    """Best-fit decreasing of one partition. In a turn that is not the last, sequences to be exchanged get no number.

    A partition whose bins equal its bound gives up only its emptiest bin, whose room is what rounding up costs; one
    with a gap gives up every bin with room. What stays is certified by a bound of its own.
    """
    rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    lengths = rows["length"].to_numpy()
    bins, offsets, n = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    give_up = np.zeros(len(bins), bool)
    if not last:
        filled = np.bincount(bins, weights=lengths, minlength=n)
        free = filled < capacity if n > bound else np.arange(n) == filled.argmin()
        give_up = free[bins]
        n, bound = n - int(free.sum()), lower_bound(lengths[~give_up], capacity)
    part = (turn << 56) + (rows["part"][0].as_py() << 24)
    rows = rows.drop_columns("part")
    for name, values, mask in (("sequence_id", part + bins, give_up), ("offset", offsets, None), ("part", np.full(len(bins), part), None), ("part_bins", np.full(len(bins), n), None), ("part_bound", np.full(len(bins), bound), None)):
        rows = rows.append_column(name, pa.array(values, pa.int64(), mask=mask))
    return rows


def _packer(capacity: int, turn: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _pack_part(rows, capacity, turn, last)


def pack(pieces: DataFrame, capacity: int, partition_rows: int = 32_768, turns: int = 3) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) in sequences of `capacity` ids, as few as possible.

    Adds sequence_id and offset; each sequence is filled from 0 without gaps; and the part of the table that holds it, with
    the part's number of sequences (part_bins) and the number that it can't go below (part_bound). Pieces are dealt by hash to partitions of
    about `partition_rows` rows, each packed by best-fit decreasing and compared with its lower bound. Whole pieces are
    a sequence each and are not dealt. Partitions with a gap exchange the pieces of their unfilled sequences with
    those of the others, in fewer partitions each turn, and are packed again; the last turn keeps everything. No piece
    is dropped; equal rows are packed one by one; an empty table gives an empty table. See certificate() for the whole.
    """
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    added = ["sequence_id", "offset", "part", "part_bins", "part_bound"]
    shape = StructType([*pieces.schema, *(StructField(n, LongType()) for n in added)])
    number = F.lit(127 << 56) + F.monotonically_increasing_id()
    one = F.lit(1).cast("long")  # a whole piece is a part of its own
    values = (number, F.lit(0).cast("long"), number, one, one)
    whole = pieces.where(F.col("length") == capacity).select("*", *(v.alias(n) for n, v in zip(added, values, strict=True)))
    done, left = [whole], pieces.where(F.col("length") < capacity)
    for turn in range(turns):
        n = left.count()
        parts = max(1, math.ceil(n / partition_rows))
        last = turn == turns - 1 or parts == 1
        key = F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(parts)).alias("part")
        packed = left.select("*", key).groupBy("part").applyInArrow(_packer(capacity, turn, last), shape)
        if last:
            done.append(packed)
            break
        packed = durable(packed, "packed")
        done.append(packed.where(F.col("sequence_id").isNotNull()))
        left = packed.where(F.col("sequence_id").isNull()).drop(*added)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """How many sequences there are, and how many no packing of these pieces can go below.

    What comes to the driver is a count for each length: `capacity` rows at most.
    """
    sequences = packed.select("sequence_id").distinct().count()
    count = np.zeros(capacity + 1, np.int64)
    for row in packed.groupBy("length").count().collect():
        count[row["length"]] = row["count"]
    return sequences, bound_of_counts(count)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise whole documents and pack them; see token_pieces and pack. Tokenisation runs once."""
    return pack(durable(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
