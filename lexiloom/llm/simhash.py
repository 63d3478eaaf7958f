"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components.

Two uses share the code. With 64 bits and a small distance the blocks are a pigeonhole: bits are split into B blocks of
which a pair within distance d must share B - d, and every choice of B - d blocks is a key, so no pair is missed. For
a wide distance (a shingle similarity of 0.8 is a tenth to a sixth of all bits) no such split is selective; then the
fingerprint is made longer and single blocks of it are the keys, as many as a stated recall takes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from lexiloom.llm.common import connected_components, durable, sift, unused

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Each byte's bits, lowest first, as the bytes of a 64-bit word: up to 255 such words add up without a carry.
_SPREAD = np.ascontiguousarray((np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.uint8)).view("<u8")[:, 0]
#: Runs up to _SHORT have their pairs compared together, those up to _LONG one by one; longer ones are searched breadth first.
_SHORT, _LONG = 96, 4096
#: Candidates per member from which a run is compared with its first member before any pairs.
MANY = 2
#: Sets of up to so many shingles also get MINS keys of ROWS minima each: their bits differ by more than the angle says.
FEW, MINS, ROWS = 80, 16, 4
#: Rows that a task works on at once.
PART = 512
#: Words of a fingerprint beside its key that are compared first.
SKETCH = 2
#: Standard deviations of slack for the Hamming distance before shingles are compared.
SLACK = 4


@dataclass(frozen=True)
class Plan:
    """How fingerprints are made and split. `keys` holds the bit ranges of each key.

    With a `similarity`, fingerprints are those of shingle sets, and pairs within the distance count if their sets reach it.
    """

    shingle: int
    words: int
    distance: int
    keys: tuple[tuple[tuple[int, int], ...], ...]
    similarity: float | None = None


def pigeonhole_plan(n: int, shingle: int = 4, distance: int = 4) -> Plan:
    """64 bits in the fewest blocks whose keys are about as long as n fingerprints need: every close pair shares a key.

    More blocks give longer and more keys, so candidates stay in proportion to n at any size.
    """
    for blocks in range(distance + 1, 17):
        share = blocks - distance
        if 64 * share // blocks >= math.log2(max(n, 2)) - 2:
            break
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return Plan(shingle, 1, distance, tuple(combinations(spans, share)))


def similarity_plan(n: int, similarity: float = 0.8, shingle: int = 5, recall: float = 0.98, words: int = 32) -> Plan:
    """Enough blocks that a pair whose shingles have this Jaccard similarity shares one with probability `recall`.

    Two sets of one size with similarity J have cosine 2J / (1 + J), and each bit differs with the angle over 180
    degrees. Blocks get longer with n: about 8 to 16 fingerprints share one by chance at any n, which costs a few bit
    counts each and saves blocks. The whole fingerprint, of at
    least `words` 64-bit words, sorts out pairs SLACK standard deviations beyond the expected distance; exact sets decide
    the rest. Pairs of up to FEW shingles share one of MINS keys with probability 0.9998 and need no distance.
    """
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    length = max(12, math.ceil(math.log2(max(n, 2))) - 4)
    bands = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** length))
    words = max(words, math.ceil(bands * length / 64))
    keys = tuple(((k * length, (k + 1) * length),) for k in range(bands))
    bits = words * 64
    return Plan(shingle, words, math.ceil(differ * bits + SLACK * math.sqrt(bits * differ * (1 - differ))), keys, similarity)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of a text's word shingles in order. A-Z become lower case; a text with fewer words is one shingle."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    n = max(1, len(parts) - shingle + 1)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:n].tolist()
    stops = ends[len(parts) - n :].tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def simhash(hashes: np.ndarray, words: int = 1) -> bytes:
    """SimHash of shingles as little-endian 64-bit words; all bits are 0 where there are none.

    Further words of the fingerprint hash the shingles' hashes anew.
    """
    n = len(hashes)
    if not n:
        return bytes(8 * words)
    x = hashes[:, None]
    if words > 1:
        x = x ^ (np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x[:, 0] = hashes
    each = np.ascontiguousarray(x).view(np.uint8)
    set_in = np.zeros(64 * words, np.int64)
    for k in range(0, n, 255):
        set_in += _SPREAD[each[k : k + 255]].sum(axis=0).view(np.uint8)
    return np.packbits(2 * set_in > n, bitorder="little").tobytes()


def fingerprint(text: bytes, shingle: int, words: int = 1) -> bytes:
    """SimHash of a text's word shingles, repeats included."""
    return simhash(shingles(text, shingle), words)


def minima(hashes: np.ndarray) -> bytes:
    """MINS keys, each of ROWS minima of the set under hash functions of their own; nothing for a set of more than FEW."""
    if not 0 < len(hashes) <= FEW:
        return b""
    x = hashes[:, None] ^ (np.arange(1, MINS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    low = (x ^ (x >> np.uint64(32))).min(axis=0).reshape(MINS, ROWS)
    key = np.arange(MINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in low.T:
        key = ((key ^ column) * np.uint64(0xBF58476D1CE4E5B9)) ^ (key >> np.uint64(29))
    return key.astype("<u8").tobytes()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most PART rows, so that what is made of a batch is never held whole."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id and fp of every whole text; a null text is an empty one.

    With a similarity also cls (a digest of the shingle set), n (its size), mins (from minima()) and text_hash, which
    finds the text again.
    """
    fields = [docs.schema["doc_id"], StructField("fp", BinaryType())]
    shingle, words, sets = plan.shingle, plan.words, plan.similarity is not None
    if sets:
        docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        fields += [StructField("cls", BinaryType()), StructField("n", IntegerType()), StructField("mins", BinaryType()), StructField("text_hash", LongType())]
    else:
        docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = batch.column(1).cast(pa.binary()).fill_null(b"")
            if not sets:
                fps = [fingerprint(t.as_py(), shingle, words) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])
                continue
            found = [np.unique(shingles(t.as_py(), shingle)) for t in texts]
            columns = [[simhash(x, words) for x in found], [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found], [len(x) for x in found], [minima(x) for x in found]]
            columns = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], names=["doc_id", "fp", "cls", "n", "mins", "text_hash"])

    return docs.mapInArrow(run, StructType(fields))


def _alike(a: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sorted sets have this Jaccard similarity with a, or more."""
    sizes = np.array([len(x) for x in sets])
    line = np.concatenate(sets)
    at = np.minimum(np.searchsorted(a, line), len(a) - 1)
    both = np.add.reduceat((a[at] == line).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
    return both >= similarity * (len(a) + sizes - both) - 1e-9


def _words(column: pa.Array, words: int) -> np.ndarray:
    """Fingerprints as a matrix of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)


def _keys(prints: np.ndarray, key: tuple[tuple[int, int], ...]) -> np.ndarray:
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
    taken = np.concatenate([bits[:, a:b] for a, b in key], axis=1)
    wide = np.zeros((len(prints), 64), np.uint8)
    wide[:, : taken.shape[1]] = taken
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")[:, 0]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _search(ids: np.ndarray, near_to: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each component of a run, one for each member but the first: never all its pairs."""
    src, dst = [], []
    left = np.arange(len(ids))
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = near_to(at, left)
            if near.any():
                found, left = left[near], left[~near]
                src.append(np.full(len(found), ids[at]))
                dst.append(ids[found])
                stack.extend(found.tolist())
    if not src:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(src), np.concatenate(dst)


def _runs(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches sorted by key, each ending where a key ends: keys, ids, prints."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        ids = batch.column(1).to_numpy(zero_copy_only=False)
        prints = _words(batch.column(2), words)
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if len(keys) and kept and keys[0] == kept[0][0][0] and cut == 0:
            kept.append((keys, ids, prints))
            continue
        if len(keys):
            yield tuple(np.concatenate(x) for x in zip(*kept, (keys[:cut], ids[:cut], prints[:cut]), strict=True))
            kept = [(keys[cut:], ids[cut:], prints[cut:])]
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _close_pairs(prints: np.ndarray, distance: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of all pairs within the distance; nothing if there are more than `most`."""
    src, dst, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for at in range(0, len(prints), 256):
        i, j = np.nonzero(_distances(prints[at : at + 256, None], prints[None, at:]) <= distance)
        i, j = i[i < j] + at, j[i < j] + at
        n += len(i)
        if n > most:
            return None
        src.append(i)
        dst.append(j)
    return np.concatenate(src), np.concatenate(dst)


def _linker(distance: int, whole_prints: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For (key, id, words of fp) rows sorted by key and id: candidates (a, b).

    Where the words are the whole fingerprint, candidates are links, and a long run gives those of a spanning tree. Else a
    run that is very long or has MANY times more candidates than members gives its members instead, as (id, first id or
    null if that is far, key): rows stay in proportion to members, whatever the size of a group of copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, prints in _runs(batches, 1 if whole_prints else SKETCH):
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
            size = np.diff(np.r_[first, len(keys)])
            number = np.repeat(np.arange(len(size)), size)
            long = size > _SHORT
            places = [(np.empty(0, int), np.empty(0, int))]
            for lag in range(1, int(size[~long].max(initial=1))):
                pair = np.flatnonzero((keys[lag:] == keys[:-lag]) & ~long[number[lag:]])
                pair = pair[_distances(prints[pair], prints[pair + lag]) <= distance]
                places.append((pair, pair + lag))
            x, y = (np.concatenate(p) for p in zip(*places, strict=True))
            if whole_prints:
                a, b = [ids[x]], [ids[y]]
                for at, n in zip(first[long], size[long], strict=True):
                    run_prints = prints[at : at + n]
                    x, y = _search(ids[at : at + n], lambda k, left, p=run_prints: _distances(p[k], p[left]) <= distance)
                    a.append(x)
                    b.append(y)
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])
                continue
            crowded = np.bincount(number[x], minlength=len(size)) > MANY * size
            few = ~crowded[number[x]]
            pairs = [(x[few], y[few])]
            for k in np.flatnonzero(long):
                at, n = first[k], size[k]
                close = _close_pairs(prints[at : at + n], distance, MANY * n) if n <= _LONG else None
                if close is None:
                    crowded[k] = True
                else:
                    pairs.append((close[0] + at, close[1] + at))
            x, y = (np.concatenate(p) for p in zip(*pairs, strict=True))
            members = np.flatnonzero(crowded[number])
            heads = first[number[members]]
            far = _distances(prints[members], prints[heads]) > distance
            a, b = np.r_[ids[x], ids[members]], np.r_[ids[y], ids[heads]]
            no_b, no_key = np.r_[np.zeros(len(x), bool), far], np.r_[np.ones(len(x), bool), np.zeros(len(members), bool)]
            columns = pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=no_b), pa.array(np.r_[np.zeros(len(x), np.int64), keys[members]], pa.int64(), mask=no_key)
            yield pa.RecordBatch.from_arrays(list(columns), names=["a", "b", "key"])

    return run


_LINK = "a long, b long, key long"


def _sketch(prints: np.ndarray, at: int) -> np.ndarray:
    """SKETCH words of each fingerprint from a place on, going round."""
    return prints[:, np.arange(at, at + SKETCH) % prints.shape[1]]


def _keyed(prints: DataFrame, plan: Plan) -> DataFrame:
    """(key, id, sketch): every fingerprint once for each key. The sketch is a part of the print outside the key."""
    words, keys, whole, sets = plan.words, plan.keys, plan.similarity is None, plan.similarity is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch.column(0), _words(batch.column(1), words)
            for number, key in enumerate(keys):
                value = _keys(prints, key)
                value = (value ^ np.uint64(number * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
                value ^= value >> np.uint64(32)
                sketch = prints if whole else _sketch(prints, key[-1][1] // 64 + 1)
                raw = pa.array([x.tobytes() for x in np.ascontiguousarray(sketch)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), ids, raw], names=["key", "id", "sketch"])
            if not sets:
                continue
            mins = batch.column(2).to_pylist()
            few = np.array([k for k, x in enumerate(mins) if x], np.int64)
            values = np.frombuffer(b"".join(mins), "<i8").reshape(-1, MINS)
            for number in range(MINS):
                raw = pa.array([x.tobytes() for x in np.ascontiguousarray(_sketch(prints[few], number))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(values[:, number], pa.int64()), ids.take(pa.array(few)), raw], names=["key", "id", "sketch"])

    return prints.select("id", "fp", *(["mins"] if sets else [])).mapInArrow(run, "key long, id long, sketch binary")


def links(prints: DataFrame, plan: Plan, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b): links between ids of distinct fingerprints (id, fp), enough to join all pairs within the distance.

    Rows that share a key lie together, sorted, and are read as a stream. Short runs compare all their pairs, long
    ones are searched breadth first and give a spanning tree. Under a similarity, fingerprints (id, fp, n, mins) are
    compared by SKETCH words first; the Hamming distance of whole fingerprints, then the shingle sets of `texts` decide.
    A run with MANY candidates per member compares its members with its first one. Where that leaves the run in
    several components, it is searched breadth first; in a group of near copies that is seldom needed.
    """
    rows = _keyed(prints, plan).repartition("key").sortWithinPartitions("key", "id")
    if plan.similarity is None:
        return rows.mapInArrow(_linker(plan.distance, True), _LINK).select("a", "b").distinct()
    differ = math.acos(2 * plan.similarity / (1 + plan.similarity)) / math.pi
    bits = 64 * SKETCH
    loose = round(bits * differ + SLACK * math.sqrt(bits * differ * (1 - differ)))
    found = durable(rows.mapInArrow(_linker(loose, False), _LINK), "candidates")
    pairs = found.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for c in "ab":
        pairs = pairs.join(prints.select(F.col("id").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("n").alias(f"n_{c}")), c)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            a, b = (_words(batch.column(k), plan.words) for k in (2, 3))
            sizes = [batch.column(k).to_numpy() for k in (4, 5)]
            yield batch.select([0, 1]).filter(pa.array(_may_be_near(a, b, *sizes, plan)))

    pairs = durable(pairs.select("a", "b", "fp_a", "fp_b", "n_a", "n_b").mapInArrow(near, "a long, b long"), "near")
    sets = durable(_sets(texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), plan), "sets")
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}")), c)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            a, b = ([np.frombuffer(x, "<u4") for x in batch.column(k).to_pylist()] for k in (2, 3))
            alike = [bool(_alike(x, [y], plan.similarity)[0]) for x, y in zip(a, b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    linked = durable(pairs.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long"), "verified")
    crowd = found.where("key is not null").select("key", F.col("a").alias("id"))
    if crowd.isEmpty():
        return linked.distinct()
    parts = connected_components(linked, "a", "b")
    crowd = crowd.join(parts, crowd["id"] == parts["node"], "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    apart = crowd.groupBy("key").agg((F.min("part") != F.max("part")).alias("apart")).where("apart").select("key")
    crowd = durable(crowd.join(apart, "key"), "crowd")
    if crowd.isEmpty():
        return linked.distinct()
    sets = durable(_sets(texts(crowd.select("id").distinct()), plan), "sets")
    crowd = crowd.join(prints.select("id", "fp"), "id").join(sets, "id").select("key", "id", "part", "fp", "shingles")
    crowd = crowd.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_crowds(plan), "a long, b long")
    return linked.union(crowd).distinct()


def _may_be_near(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, plan: Plan) -> np.ndarray:
    """Which fingerprints are within the distance, or of short texts, if the sizes of their sets allow the similarity."""
    close = (_distances(a, b) <= plan.distance) | ((n_a <= FEW) & (n_b <= FEW))
    return close & (np.minimum(n_a, n_b) >= plan.similarity * np.maximum(n_a, n_b) - 1e-9)


def _crowds(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For (key, id, part, fp, shingles) rows sorted by key: links between parts that are known to be connected."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(batches):
            keys = rows.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for at, end in zip(first, np.r_[first[1:], len(keys)], strict=True):
                some = rows.slice(at, end - at)
                ids, part, prints = some.column(1).to_numpy(), some.column(2).to_numpy(), _words(some.column(3), plan.words)
                sets = [np.frombuffer(x, "<u4") for x in some.column(4).to_pylist()]
                sizes = np.array([len(x) for x in sets])

                def near_to(k: int, left: np.ndarray, part=part, prints=prints, sets=sets, sizes=sizes) -> np.ndarray:
                    near = part[left] == part[k]
                    other = np.flatnonzero(~near)
                    other = other[_may_be_near(prints[k], prints[left[other]], sizes[k], sizes[left[other]], plan)]
                    if len(other):
                        near[other] = _alike(sets[k], [sets[m] for m in left[other]], plan.similarity)
                    return near

                a, b = _search(ids, near_to)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return search


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, each ending where a key ends."""
    kept: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        kept = now if kept is None else pa.concat_tables([kept, now])
        keys = kept.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield kept.slice(0, cut)
            kept = kept.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept


def _sets(texts: DataFrame, plan: Plan) -> DataFrame:
    """id and the sorted 32-bit hashes of the shingles of texts (id, text).

    Of 20,000 shingles a tenth of one is taken for another's by chance, which halves what 64 bits put on disk.
    """
    shingle = plan.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = batch.column(1).cast(pa.binary()).fill_null(b"")
            raw = [np.unique(shingles(t.as_py(), shingle).astype("<u4")).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles binary")


def _grouped(docs: DataFrame, plan: Callable[[int], Plan]) -> tuple[DataFrame, bool]:
    """doc_id, fp (and text_hash under a similarity) of every row with `best`, the first member of its component.

    Members are ordered by doc_id, null last, then text_hash. Also whether rows repeat a doc_id with the same text.
    """
    made = plan(docs.count())
    prints = durable(fingerprints(docs, made), "fingerprints")
    sets = made.similarity is not None
    same, member = ("cls", ["doc_id", "text_hash"]) if sets else ("fp", ["doc_id"])
    # equal sets or fingerprints are one class
    what = [F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *member)).alias("best")]
    classes = prints.groupBy(same).agg(*what, *(F.first(c).alias(c) for c in (("fp", "n", "mins") if sets else ())))
    classes = durable(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    repeats = sets and not prints.groupBy(*member).count().where("count > 1").isEmpty()

    def texts(ids: DataFrame) -> DataFrame:
        wanted = durable(classes.join(ids, "id").select("id", F.col("best.doc_id").alias("of"), F.col("best.text_hash").alias("text_hash")), "wanted")
        maybe = sift(docs.select("doc_id", "text"), F.xxhash64("doc_id", F.xxhash64("text")), wanted, F.xxhash64("of", "text_hash"))[0]
        found = maybe.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("text_hash"))).select("id", "text")
        return found.dropDuplicates(["id"]) if repeats else found

    found = connected_components(links(classes, made, texts), "a", "b")
    classes = classes.select(same, "id", "best")
    least = classes.join(found, classes["id"] == found["node"]).groupBy("component").agg(F.min("best").alias("least"))
    classes = classes.join(found, classes["id"] == found["node"], "left").join(least, "component", "left")
    classes = classes.select(same, F.coalesce("least", "best").alias("best"))
    return prints.select(*dict.fromkeys([*member, same, "fp"])).join(classes, same), repeats


def near_duplicates(docs: DataFrame, plan: Callable[[int], Plan] = pigeonhole_plan) -> DataFrame:
    """doc_id, fp (binary) and component_id: the smallest doc_id reachable by links, itself included.

    Equal fingerprints are one class before any comparison, so copies cost one row; no link between different ones is
    lost, by whatever number of partners. A null or empty text has fingerprint zero and links as such. A null doc_id
    takes the component of its fingerprint, which is null only if no member has an id. Repeated rows each come back.
    An empty table gives an empty table. Columns other than doc_id and text are not read.
    """
    return _grouped(docs, plan)[0].select("doc_id", "fp", F.col("best.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of docs without near copies: of each component the document with the smallest doc_id stays.

    Shingles of five words and a similarity of 0.8 or more make a near copy. Documents without words are copies of
    each other. Rows that repeat a doc_id with different texts are documents of their own; of rows that repeat both,
    one stays. Documents without an id stay only in components where none has one, one of each. An empty table gives
    an empty table. All columns are returned, whatever their names.
    """
    rows, repeats = _grouped(docs, lambda n: similarity_plan(n, similarity, shingle))
    at, text_hash = unused(docs, "at"), unused(docs, "text_hash")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    key = [F.col("doc_id").alias(at), F.col("text_hash").alias(text_hash)]
    same = F.col("doc_id").eqNullSafe(F.col(at)) & (F.xxhash64("text") == F.col(text_hash))
    # only documents that may go meet what goes; the others stay where they are
    gone = durable(rows.where(~stays).select(*key).distinct(), "gone")
    maybe, others = sift(docs, F.xxhash64("doc_id", F.xxhash64("text")), gone, F.xxhash64(at, text_hash))
    kept = others.unionByName(maybe.join(gone, same, "left_anti"))
    if not repeats:
        return kept
    often = durable(rows.where(stays).groupBy(*key).count().where("count > 1").drop("count"), "repeated")
    once = kept.join(often, same, "left_semi").withColumn(text_hash, F.xxhash64("text")).dropDuplicates(["doc_id", text_hash]).drop(text_hash)
    return kept.join(often, same, "left_anti").unionByName(once)
