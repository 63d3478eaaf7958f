"""Ranked lexical search over tiers: high-impact postings first, bounds that prove a result, lower tiers for the rest.

A posting's impact is what its term adds to its document's score. A term's postings of the highest impacts form the first
tiers, each of a fixed size; what is left of a term has a residual bound, the largest impact there. After a tier an item
has lower bounds (sums of what was read) and upper bounds (residuals of terms not read added). Once no document that was
never met can reach the k-th lower bound, the item is proven: candidates are scored exactly and that is its result. Other
items fall through to the next tier; the last one holds every posting, by document, and needs no proof.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import durable

#: A term is a longest run of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Postings of a term in the first tiers, at most.
TIERS = (256, 4096)
#: Terms of the items that are searched together, repeats among items counted; what is broadcast stays within this.
MOST_TERMS = 400_000
#: Scores that a task holds at once.
CELLS = 1 << 21
#: Steps of the impacts' histogram in an octave.
STEPS = 16


def asked(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): distinct items by a number of their own, with their distinct terms.

    A null text has no terms. Rows that repeat an item wholly are one item.
    """
    found = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOW), F.lit(TERM), F.lit(0)))
    return items.select("item_id", "text").distinct().select("item_id", found.alias("terms")).withColumn("item", F.monotonically_increasing_id())


def forward_index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every whole text: all its terms counted, and those that `number` knows with their frequencies."""
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>"
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()).fill_null(b""):
                words = text.as_py().translate(_SPACE).split()
                ids = np.fromiter(map(get, words, [-1] * len(words)), np.int32, len(words))
                held, tf = np.unique(ids[ids >= 0], return_counts=True)
                n.append(len(words))
                terms.append(held)
                tfs.append(tf.astype(np.int32))
                ends.append(ends[-1] + len(held))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, fields)


def _flat(batch: pa.RecordBatch, terms: int, tfs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's postings: row, term, frequency."""
    a, b = batch.column(terms), batch.column(tfs)
    rows = np.repeat(np.arange(batch.num_rows), np.diff(a.offsets.to_numpy()))
    return rows, a.flatten().to_numpy(), b.flatten().to_numpy()


class Impacts:
    """impact(n, term, tf) in whole numbers, by the corpus's counts and the terms' weights."""

    def __init__(self, documents: int, length: int, df: np.ndarray):
        self.documents, self.length = documents, max(length, 1)
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def __call__(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 50 + 50 * n.astype(np.int64) * self.documents // self.length
        tf = tf.astype(np.int64)
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def statistics(forward: DataFrame, size: int) -> Impacts:
    """The corpus's counts over all documents, and df of the numbered terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df[term], pa.int64())], names=["term", "df"])

    n, length = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = forward.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(size, np.int64)
    df[found["term"]] = found["df"]
    return Impacts(n, length, df)


def tier_cuts(forward: DataFrame, impacts: Impacts, size: int, tiers: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """By tier and term: the least impact that the tiers so far hold, and the residual bound of what they don't.

    Cuts lie on the steps of a histogram, so tiers hold no more than their size, and equal impacts stay together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, term, tf = _flat(batch, 1, 2)
            impact = impacts(batch.column(0).to_numpy()[rows], term, tf)
            step = np.floor(np.log2(np.maximum(impact, 1)) * STEPS).astype(np.int64)
            order = np.lexsort((impact, step, term))
            key = (term.astype(np.int64) << 16 | step)[order]
            last = np.flatnonzero(np.r_[key[1:] != key[:-1], np.ones(min(len(key), 1), bool)])
            first = np.r_[0, last[:-1] + 1] if len(last) else last
            columns = key[last] >> 16, key[last] & 0xFFFF, last - first + 1, impact[order][first], impact[order][last]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["term", "step", "n", "least", "most"])

    found = forward.select("n", "terms", "tfs").mapInArrow(count, "term long, step long, n long, least long, most long")
    found = found.groupBy("term", "step").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    above = F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("step")))
    kept = lambda c: F.min(F.when(F.col("above") <= c, F.col("least")))
    left = lambda c: F.max(F.when(F.col("above") > c, F.col("most")))
    found = found.withColumn("above", above).groupBy("term").agg(*(f(c).alias(f"{x}{k}") for k, c in enumerate(tiers) for x, f in (("cut", kept), ("rest", left)))).toPandas()
    cut, rest = np.full((len(tiers), size), np.iinfo(np.int64).max), np.zeros((len(tiers), size), np.int64)
    for k in range(len(tiers)):
        for to, column in ((cut, found[f"cut{k}"]), (rest, found[f"rest{k}"])):
            there = column.notna()
            to[k, found.loc[there, "term"]] = column[there].astype("int64")
    return cut, rest


def _postings(forward: DataFrame, impacts: Impacts, cut: np.ndarray) -> DataFrame:
    """(tier, term, row, impact) of the postings of the first tiers, each in the first tier that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, term, tf = _flat(batch, 2, 3)
            impact = impacts(batch.column(1).to_numpy()[rows], term, tf)
            tier = (impact < cut[:, term]).sum(axis=0)
            held = np.flatnonzero(tier < len(cut))
            columns = pa.array(tier[held], pa.int32()), pa.array(term[held], pa.int32()), batch.column(0).take(pa.array(rows[held])), pa.array(impact[held], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns), names=["tier", "term", "row", "impact"])

    return forward.select("row", "n", "terms", "tfs").mapInArrow(run, "tier int, term int, row long, impact long")


class Items:
    """Items and their terms as arrays: of each term the items that hold it."""

    def __init__(self, item: np.ndarray, term: np.ndarray, size: int):
        order = np.argsort(term, kind="stable")
        self.ids, place = np.unique(item[order], return_inverse=True)
        self.items, self.count = place.astype(np.int64), np.bincount(term, minlength=size)
        self.first = np.r_[0, np.cumsum(self.count)[:-1]]

    def scores(self, rows: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
        """The score of each of n rows for each item."""
        often = self.count[term]
        ends = np.cumsum(often)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - often, often)
        item = self.items[np.repeat(self.first[term], often) + at]
        out = np.zeros(n * len(self.ids), np.int64)
        np.add.at(out, np.repeat(rows, often) * len(self.ids) + item, np.repeat(impact, often))
        return out.reshape(n, len(self.ids))


def _best(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Of (item, score, unnamed, doc) each item's k best: highest score, then smallest document, those without an id last."""
    item, score, unnamed, doc = found
    order = np.lexsort((doc, unnamed, -score, item))
    item = item[order]
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, np.int64)
    place = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
    return tuple(x[order][place < k] for x in found)


def _scan(forward: DataFrame, impacts: Impacts, items: Items, floors: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item by task, none below the item's floor. The last tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = tuple(np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))
        least = np.maximum(floors, 1)
        for whole in batches:
            step = max(1, CELLS // max(1, len(items.ids)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rows, term, tf = _flat(batch, 2, 3)
                scores = items.scores(rows, term, impacts(batch.column(1).to_numpy()[rows], term, tf), batch.num_rows)
                row, item = np.nonzero(scores >= least)
                if not len(row):
                    continue
                ids = batch.column(0).cast(pa.int64())
                new = item, scores[row, item], ids.is_null().to_numpy(zero_copy_only=False)[row], ids.fill_null(0).to_numpy()[row]
                best = _best(tuple(np.concatenate(x) for x in zip(best, new, strict=True)), k)
                full = np.bincount(best[0], minlength=len(least)) >= k
                last = np.full(len(least), np.iinfo(np.int64).max)
                np.minimum.at(last, best[0], best[1])
                least = np.where(full, np.maximum(least, last), least)
        columns = pa.array(items.ids[best[0]], pa.int64()), pa.array(best[3], pa.int64(), mask=best[2]), pa.array(best[1], pa.int64())
        yield pa.RecordBatch.from_arrays(list(columns), names=["item", "doc_id", "score"])

    return forward.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item long, doc_id long, score long")


def _exact(forward: DataFrame, candidates: DataFrame, impacts: Impacts, items: Items) -> DataFrame:
    """(item, doc_id, score) of candidates (item, row) by their documents' postings in all tiers."""
    wanted = candidates.groupBy("row").agg(F.collect_set("item").alias("asked"))
    rows = forward.join(wanted, "row").select("doc_id", "n", "terms", "tfs", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(items.ids)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, term, tf = _flat(batch, 2, 3)
                scores = items.scores(row, term, impacts(batch.column(1).to_numpy()[row], term, tf), batch.num_rows)
                item = batch.column(4).flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(4).offsets.to_numpy()))
                columns = pa.array(item, pa.int64()), batch.column(0).cast(pa.int64()).take(pa.array(row)), pa.array(scores[row, np.searchsorted(items.ids, item)], pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns), names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long").where("score > 0")


def _search(docs: DataFrame, items: DataFrame, k: int, tiers: tuple[int, ...]) -> DataFrame:
    """(item, doc_id, score): at least each item's k best documents, and the tier that settled it."""
    spark = docs.sparkSession
    pairs = items.select("item", F.explode("terms").alias("term")).toPandas()  # MOST_TERMS rows at most, or one item
    terms = pairs["term"].unique()
    number = {t.encode(): i for i, t in enumerate(terms)}
    size = len(number)
    pairs["term"] = pairs["term"].map({t: i for i, t in enumerate(terms)}).astype("int32")
    forward = durable(forward_index(docs, number).withColumn("row", F.monotonically_increasing_id()), "forward")
    impacts = statistics(forward, size)
    if tiers:
        cut, rest = tier_cuts(forward, impacts, size, tiers)
        postings = durable(_postings(forward, impacts, cut), "postings")
    left, floors = pairs, {}
    out = None
    for tier in range(len(tiers)):
        if not len(left):
            break
        held = left.assign(rest=rest[tier, left["term"]])
        most = held.groupby("item")["rest"].sum()  # what a document that was never met can reach
        wanted = spark.createDataFrame(held[["item", "term", "rest"]], "item long, term int, rest long")
        met = postings.where(F.col("tier") <= tier).join(F.broadcast(wanted), "term")
        met = met.groupBy("item", "row").agg(F.sum("impact").alias("low"), F.sum("rest").alias("read"))
        met = durable(met, "met")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
        kth = met.where("low > 0").withColumn("place", place).where(F.col("place") == k).select("item", "low").toPandas()
        floor = dict(zip(kth["item"], kth["low"], strict=True))
        floors |= {i: max(x, floors.get(i, 0)) for i, x in floor.items()}
        proven = [int(i) for i, x in most.items() if x == 0 or x < floors.get(i, 0)]
        if not proven:
            continue
        bounds = spark.createDataFrame([(i, int(most[i]), int(floors.get(i, 0))) for i in proven], "item long, most long, floor long")
        candidates = met.join(F.broadcast(bounds), "item").where("low + most - read >= floor").select("item", "row")
        settled = left[left["item"].isin(proven)]
        found = _exact(forward, candidates, impacts, Items(settled["item"].to_numpy(), settled["term"].to_numpy(), size)).withColumn("tier", F.lit(tier))
        out = found if out is None else out.unionByName(found)
        left = left[~left["item"].isin(proven)]
    if len(left):
        asking = Items(left["item"].to_numpy(), left["term"].to_numpy(), size)
        found = _scan(forward, impacts, asking, np.array([floors.get(i, 0) for i in asking.ids], np.int64), k).withColumn("tier", F.lit(len(tiers)))
        out = found if out is None else out.unionByName(found)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score and tier: each item's k highest-scoring documents with a score above 0.

    Equal scores stand by doc_id, those without one last. `tier` is the tier that settled the item, len(tiers) where
    all postings were read; the result is the same whichever it is. A document is a row: repeated rows and rows without
    an id are each found; a null text has no terms, and an item without terms finds nothing. Rows that repeat an item
    wholly are one item; an item_id with several texts asks each of them. Empty tables give an empty table. Columns
    other than doc_id, text and item_id are not read. Items are searched MOST_TERMS terms at a time.
    """
    items = durable(asked(items), "items")
    terms = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    batches = max(1, math.ceil(terms / MOST_TERMS))
    out = None
    for k_batch in range(batches):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == k_batch) if batches > 1 else items
        found = _search(docs, some, k, tiers)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item long, doc_id long, score long, tier int")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    out = out.withColumn("rank", place).where(F.col("rank") <= k)
    return out.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score", "tier")
