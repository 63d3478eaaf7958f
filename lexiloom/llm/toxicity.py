"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import durable

#: N-grams of these lengths fall into so many buckets.
LENGTHS, BITS = (4, 6, 8), 21
_SEED = {4: 0x85EBCA6B, 6: 0xC2B2AE35, 8: 0x27D4EB2F}


class Grams:
    """The distinct buckets of a text's n-grams. Lower case; white space counts as one space, also at both ends."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        line = " " + " ".join((text or "").lower().split()) + " "
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
        found = []
        for n in LENGTHS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, _SEED[n], np.uint32)
            for k in range(n):
                h ^= codes[k : len(codes) - n + 1 + k]
                h *= np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            found.append(h >> np.uint32(32 - BITS))
        if not found:
            return np.empty(0, np.uint32)
        buckets = np.concatenate(found)
        # the last place that writes a bucket is the one that keeps it
        places = np.arange(len(buckets), dtype=np.int32)
        self.seen[buckets] = places
        return buckets[self.seen[buckets] == places]


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(bias + the sum of a text's distinct buckets' weights)))."""

    weights: np.ndarray
    bias: float

    def scorer(self) -> Callable[[str | None], float]:
        grams, weights, bias = Grams(), self.weights, self.bias
        return lambda text: 1 / (1 + math.exp(-max(-500.0, min(500.0, bias + float(weights[np.sort(grams(text))].sum())))))


def held_out():
    """Rows that are never learned from."""
    return (F.crc32(F.col("doc_id").cast("string")) % 4) == 2


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text and label (0 or 1) of about `most` labelled rows at most, chosen by a hash of doc_id.

    Held-out rows, rows without an id and other labels are left out; a doc_id with both labels counts as 1. The chosen
    ids are broadcast: `most` bounds their number, give or take the spread of a hash.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (most / n)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many of a task's texts of each label have each bucket; bucket -1 counts the texts."""
    grams, has = Grams(), np.zeros((2, 1 << BITS), np.int32)
    texts = np.zeros(2, np.int64)
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            has[label, grams(text)] += 1
            texts[label] += 1
    bucket = np.flatnonzero(has.any(axis=0))
    yield pd.DataFrame({"bucket": np.r_[-1, bucket], "zero": np.r_[texts[0], has[0, bucket]], "one": np.r_[texts[1], has[1, bucket]]})


def log_count_ratios(counts: DataFrame, zeros: int, ones: int, alpha: float, features: int) -> pd.DataFrame:
    """bucket and ratio of the `features` buckets that tell the labels apart best.

    A ratio over its standard error ranks buckets, so rare ones don't win by chance.
    """
    one, zero = F.col("one") + alpha, F.col("zero") + alpha
    ratio = F.log(one / (ones + 2 * alpha)) - F.log(zero / (zeros + 2 * alpha))
    rank = F.abs("ratio") / F.sqrt(1 / one + 1 / zero)
    rows = counts.where("bucket >= 0").withColumn("ratio", ratio).orderBy(rank.desc(), "bucket").limit(features)
    return rows.select("bucket", "ratio").toPandas()


def train(
    docs: DataFrame, labels: DataFrame, most: int = 20_000, alpha: float = 1.0, features: int = 16_384, strength: float = 1e-3
) -> Model:
    """Fit on at most about `most` labelled rows; what leaves the executors is `features` buckets.

    Without rows of both labels every text scores the share of label 1, smoothed by one row of each.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    texts = durable(sample(docs, labels, most), "labelled")
    counts = texts.mapInPandas(_counts, "bucket long, zero long, one long")
    counts = durable(counts.groupBy("bucket").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")), "counts")
    total = counts.where("bucket < 0").agg(F.coalesce(F.sum("zero"), F.lit(0)), F.coalesce(F.sum("one"), F.lit(0))).first()
    zeros, ones = total
    weights = np.zeros(1 << BITS)
    if not zeros or not ones:
        return Model(weights, math.log((ones + 1) / (zeros + 1)))
    best = log_count_ratios(counts, zeros, ones, alpha, features)
    buckets, ratios = best["bucket"].to_numpy(), best["ratio"].to_numpy()
    chosen = np.zeros(1 << BITS, bool)
    chosen[buckets] = True

    def features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for batch in batches:
            found = [g[chosen[g]] for g in map(grams, batch["text"])]
            yield pd.DataFrame({"grams": [list(map(str, g.tolist())) for g in found], "label": batch["label"].astype("float64")})

    rows = durable(texts.mapInPandas(features_of, "grams array<string>, label double"), "features")
    vectorizer = CountVectorizerModel.from_vocabulary([str(b) for b in buckets], "grams", "present")
    vectorizer = vectorizer.setBinary(True)
    scale = ElementwiseProduct(scalingVec=Vectors.dense(ratios), inputCol="present", outputCol="features")
    fitted = LogisticRegression(regParam=strength, standardization=False, maxIter=50, tol=1e-5).fit(scale.transform(vectorizer.transform(rows)))
    weights[buckets] = fitted.coefficients.toArray() * ratios
    return Model(weights, float(fitted.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text; a null text is an empty one. Repeated rows each come back."""
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            scores = [of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Scores come from the text alone. held_out is null for a null doc_id; other columns are not read; no documents give
    an empty table, no labels a score of 0.5 for all.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, in one pass without a shuffle.

    A null text is an empty one; repeated rows are each kept or not; labels that name no document, or none at all, leave
    a score that is the same for every text; an empty table gives an empty table.
    """
    model = train(docs, labels)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")

    return docs.where(scores("text") < threshold)
