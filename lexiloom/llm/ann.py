"""Approximate nearest neighbours from randomly rotated one-bit codes.

A unit vector is rotated into more dimensions by a random matrix with orthonormal columns and kept as its signs, a packed
code, with one scalar: the inner product of the rotated vector and its code. A query, rotated alike and rounded to a
few bits, meets codes by AND and bit counts alone; divided by the scalar that is an unbiased estimate of the cosine,
with an error bound that depends on the scalar. Only vectors whose upper bound reaches the fifth best lower bound are
compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import durable
from lexiloom.llm.embedding_dedup import dots, matrix, scaled, unit, usable

#: Rows of a block of candidates, and of a block of queries.
ROWS, ASKED = 4096, 512


@dataclass(frozen=True)
class Coder:
    """A random rotation of `dim` dimensions into `bits`, the same on every worker."""

    dim: int
    bits: int
    query_bits: int = 5
    bound: float = 3.0
    seed: int = 7

    def rotation(self) -> np.ndarray:
        gauss = np.random.default_rng(self.seed).standard_normal((self.bits, self.dim))
        return np.linalg.qr(gauss)[0]

    def encode(self, x: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes and scalars of unit vectors. A code stands for its signs over the root of `bits`."""
        turned = x @ rotation.T
        codes = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
        return codes, np.abs(turned).sum(axis=1) / np.sqrt(self.bits)

    def planes(self, q: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rotated queries as bit planes of whole numbers: planes, step, low and the largest error of rounding."""
        turned = q @ rotation.T
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**self.query_bits - 1), 1e-12)
        whole = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        planes = np.stack([np.packbits(whole >> k & 1, axis=1, bitorder="little").view("<u8") for k in range(self.query_bits)], axis=1)
        return planes, step, low, whole.sum(axis=1, dtype=np.int64)

    def estimate(self, codes: np.ndarray, ones: np.ndarray, scalars: np.ndarray, planes: np.ndarray, step: float, low: float, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosine estimates of one query against all codes, and their error bounds.

        With signs s and whole numbers w the inner product is the sum of s * (low + step * w), and
        sum(s * w) = 2 * sum of w where the bit is set - sum(w).
        """
        at_ones = np.zeros(len(codes), np.int64)
        for k in range(self.query_bits):
            at_ones += np.bitwise_count(codes & planes[k]).sum(axis=1, dtype=np.int64) << k
        dot = (step * (2 * at_ones - total) + low * (2 * ones - self.bits)) / np.sqrt(self.bits)
        error = self.bound * np.sqrt(np.maximum(0, 1 - scalars**2) / (self.bits - 1))
        return dot / scalars, (error + 0.5 * step) / scalars


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _indexer(bits: int, seed: int) -> Callable[[Iterator[pa.Table]], pa.Table]:
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        coder = Coder(dim, max(bits, -(-dim // 64) * 64), seed=seed)
        rows = rows.sort_by("vec_id")
        x = scaled(matrix(rows["embedding"].combine_chunks()))
        codes, scalars = coder.encode(unit(x), coder.rotation())
        blob = lambda a: [np.ascontiguousarray(a).tobytes()]
        return pa.table({"dim": [dim], "block": [key[1].as_py()], "ids": blob(rows["vec_id"].to_numpy().astype(np.int64)), "codes": blob(codes), "scalars": blob(scalars), "vectors": blob(x)},
                        schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in ("ids", "codes", "scalars", "vectors"))]))

    return pack


_BLOB = "dim int, block long, ids binary, codes binary, scalars binary, vectors binary"


def blocks(vectors: DataFrame, rows: int, bits: int, seed: int) -> DataFrame:
    """Vectors packed to blobs of about `rows`, dealt by hash: ids, codes, scalars, vectors. Every row is indexed."""
    counts = vectors.groupBy("dim").agg(F.ceil(F.count("*") / rows).alias("parts"))
    dealt = vectors.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return dealt.groupBy("dim", "block").applyInArrow(_indexer(bits, seed), _BLOB)


def _searcher(k: int, bits: int, seed: int):
    """For rows of a query block and a block of candidates: each query's k nearest there.

    Rows of one query block come together; what a query has found so far bounds what later blocks must reach. In any
    other order results are the same, and more rows are handed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim, asked, q_ids, q_vectors, ids, codes, scalars, vectors = (c[row].as_py() for c in batch.columns)
                coder = Coder(dim, max(bits, -(-dim // 64) * 64), seed=seed)
                if now != (dim, asked):
                    if state:
                        yield _found(state)
                    q = np.frombuffer(q_vectors, np.float64).reshape(-1, dim)
                    state = {"ids": np.frombuffer(q_ids, np.int64), "q": q, "norm": np.sqrt(dots(q, q)), "best": [(np.empty(0, np.int64), np.empty(0))] * len(q)}
                    state["planes"] = coder.planes(unit(q), coder.rotation())
                    now = (dim, asked)
                _search(state, coder, k, np.frombuffer(ids, np.int64), np.frombuffer(codes, "<u8").reshape(-1, coder.bits // 64), np.frombuffer(scalars, np.float64), np.frombuffer(vectors, np.float64).reshape(-1, dim))
        if state:
            yield _found(state)

    return run


def _search(state: dict, coder: Coder, k: int, ids: np.ndarray, codes: np.ndarray, scalars: np.ndarray, vectors: np.ndarray) -> None:
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    lengths = np.sqrt(dots(vectors, vectors))
    for n, own in enumerate(state["ids"].tolist()):
        guess, error = coder.estimate(codes, ones, scalars, *(x[n] for x in state["planes"]))
        known_ids, known = state["best"][n]
        low = guess - error
        low[ids == own] = -np.inf
        reach = known[-1] if len(known) == k else -np.inf
        if len(low) > k:
            reach = max(reach, np.partition(low, len(low) - k)[len(low) - k])
        some = np.flatnonzero((guess + error >= reach) & (ids != own))
        scores = dots(vectors[some], state["q"][n]) / (lengths[some] * state["norm"][n])
        all_ids, all_scores = np.r_[known_ids, ids[some]], np.r_[known, scores]
        best = _best(all_ids, all_scores, k)
        state["best"][n] = all_ids[best], all_scores[best]


def _found(state: dict) -> pa.RecordBatch:
    sizes = [len(ids) for ids, _ in state["best"]]
    columns = np.repeat(state["ids"], sizes), np.concatenate([i for i, _ in state["best"]]), np.concatenate([s for _, s in state["best"]])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: Column, k: int = 5, bits: int = 256, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of every row that `queries` marks, among all other rows.

    Ties go to the smaller vec_id. Vectors without an id, unusable ones (see embedding_dedup.usable) and those of
    another length take no part; fewer candidates give fewer rows, an empty table none. Rows that repeat a vec_id are one
    query (one of them, by chance, where vectors differ), which none of them answers; for other queries each is a
    candidate of its own. Other columns are not read. Candidates lie in blocks of codes; each stripe of blocks meets every block of queries in one place, and only
    k rows for each query and stripe are brought together.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable())
    rows = rows.withColumn("dim", F.size("embedding"))
    index = durable(blocks(rows, ROWS, bits, seed), "index")
    asked = durable(blocks(rows.where(queries).dropDuplicates(["vec_id"]), ASKED, bits, seed), "queries")
    stripes = max(24, index.count() // 8)
    index = index.withColumn("stripe", F.pmod("block", F.lit(stripes))).select("dim", "stripe", "ids", "codes", "scalars", "vectors")
    # a stated set of queries meets all rows, in blocks; a merge join gives a query block with all blocks of its stripe
    asked = asked.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
    asked = asked.select("dim", "stripe", F.expr(f"block * {stripes} + stripe").alias("asked"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    met = asked.hint("merge").join(index, ["dim", "stripe"]).select("dim", "asked", "q_ids", "q_vectors", "ids", "codes", "scalars", "vectors")
    found = met.mapInArrow(_searcher(k, bits, seed), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
