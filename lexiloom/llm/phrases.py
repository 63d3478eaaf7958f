"""Phrase collocations: merged count-min sketches find what may be frequent, a second pass counts only that, exactly.

The first pass puts every phrase of up to three words into a count-min sketch. Tasks give sorted cells, sketches are merged
by ranges of cells, and cells that reach the threshold become a map of bits. An estimate is never below the true count, so
the second pass, which counts the phrases whose cells are all set, misses nothing frequent. Cells grow with the corpus, so
that a rare phrase seldom passes; the map is folded where it would outgrow what may be broadcast, and then more phrases
are counted, none fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import durable

_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z become lower case, whatever ends a piece becomes a full stop.
_CLEAN = bytes(46 if c in _ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows of the sketch, bytes of text for each of its cells in a row; cells that are merged together, at least and at most.
DEPTH, BYTES, BLOCK, MOST_BLOCK = 2, 8, 1 << 20, 1 << 22
#: Bits of a row's map, at most: what is broadcast is DEPTH times that, 128 MB in all.
MOST_BITS = 1 << 29
#: Words that a task numbers and holds at once. Numbers have 21 bits, so that three of them are one key.
WORDS, PART = 1 << 20, 1 << 19
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Numbers:
    """Words of each language as numbers from 1 on; 0 ends a piece. Emptied when it is full."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, dict[bytes, int]] = {}
        self.words, self.langs, self.hashes = [b"."], [""], [0]

    def __call__(self, lang: str, words: list[bytes]) -> np.ndarray:
        of = self.of.setdefault(lang, {b".": 0})
        seed = xxhash.xxh64_intdigest(lang.encode(), 7)
        ids = list(map(of.get, words))
        if None in ids:
            for at, word in enumerate(words):
                if ids[at] is None:
                    number = of.get(word)
                    if number is None:
                        number = of[word] = len(self.words)
                        self.words.append(word)
                        self.langs.append(lang)
                        self.hashes.append(xxhash.xxh64_intdigest(word, seed))
                    ids[at] = number
        return np.array(ids, np.int64)


def _parts(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Numbers, np.ndarray, np.ndarray]]:
    """Numbered words of whole texts, PART words or so at a time, pieces apart by 0, and where phrases may begin. Columns: lang, text.

    A longer text is taken in turns that overlap by the words of a phrase less one, in which none begins.
    """
    numbers, kept, n = Numbers(), [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            words = (text.as_py() or b"").translate(_CLEAN).replace(b".", b" . ").split()
            for at in range(0, len(words), PART):
                some = words[at : at + PART + longest - 1]
                if n and (n + len(some) > PART or len(numbers.words) + len(some) > WORDS):
                    yield numbers, *map(np.concatenate, zip(*kept, strict=True))
                    kept, n = [], 0
                if len(numbers.words) + len(some) > WORDS:
                    numbers.clear()
                kept += [(numbers(lang.as_py(), some), np.arange(len(some)) < PART), (np.zeros(1, np.int64), np.zeros(1, bool))]
                n += len(some)
    if n:
        yield numbers, *map(np.concatenate, zip(*kept, strict=True))


def _grams(ids: np.ndarray, begins: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the places where a phrase of it begins."""
    inside = ids > 0
    begins = begins & inside
    for k in range(1, longest + 1):
        if k > 1:
            begins = begins[:-1] & inside[k - 1 :]
        yield k, np.flatnonzero(begins)


def _cells(numbers: Numbers, ids: np.ndarray, begins: np.ndarray, longest: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the places of its phrases, and their cells in each row of the sketch."""
    hashes = np.array(numbers.hashes, np.uint64)[ids]
    for k, at in _grams(ids, begins, longest):
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = (h ^ hashes[at + j]) * _ODD[0]
            h ^= h >> np.uint64(29)
        rows = []
        for odd in _ODD[1 : 1 + DEPTH]:
            x = h * odd
            rows.append((x ^ (x >> np.uint64(32))) & np.uint64(width - 1))
        yield k, at, np.stack(rows)


def sketch_width(docs: DataFrame) -> int:
    """Cells of a row: about one for BYTES bytes of text, a power of two."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(BLOCK, 1 << (size // BYTES).bit_length())


def sketch(docs: DataFrame, longest: int, least: int, width: int) -> list[np.ndarray]:
    """Maps of bits, one a row: which cells reach `least` in the merged sketch, folded to MOST_BITS.

    docs: lang, text. A task's cells travel sorted, as 16-bit steps, each at most `least` times: more changes nothing. What
    merging costs is in proportion to the cells that travel, whatever the width.
    """
    block_size = max(BLOCK, min(MOST_BLOCK, width >> 8))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, ids, begins in _parts(batches, longest):
            found = [[] for _ in range(DEPTH)]
            for _, _, rows in _cells(numbers, ids, begins, longest, width):
                for held, row in zip(found, rows, strict=True):
                    held.append(row.astype(np.uint32) if width <= 1 << 32 else row)
            for row, held in enumerate(found):
                line = np.sort(np.concatenate(held)).astype(np.int64)
                line = line[np.r_[np.ones(min(least, len(line)), bool), line[least:] != line[:-least]]]
                blocks, starts = np.unique(line // block_size, return_index=True)
                raw = [_steps(x - b * block_size) for b, x in zip(blocks, np.split(line, starts[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row * (width // block_size) + blocks, pa.int64()), pa.array(raw, pa.binary())], names=["block", "steps"])

    bits = min(width, MOST_BITS)
    blocks, folds = width // block_size, bits // block_size

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, held, out = None, None, np.zeros(block_size, np.int32), np.zeros(block_size // 8, np.uint8)
        for batch in batches:
            for to, block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != now:
                    out |= np.packbits(held >= least, bitorder="little")
                    now = block
                    held[:] = 0
                    if to != fold:
                        if fold is not None:
                            yield _folded(fold, out)
                        fold, out = to, np.zeros(block_size // 8, np.uint8)
                np.add.at(held, _places(np.frombuffer(raw.as_py(), "<u2")), 1)
        if now is not None:
            yield _folded(fold, out | np.packbits(held >= least, bitorder="little"))

    rows = docs.select("lang", "text").mapInArrow(cells, "block long, steps binary")
    fold = F.expr(f"block div {blocks} * {folds} + block % {blocks} % {folds}").alias("fold")
    rows = rows.select(fold, "block", "steps").repartition("fold").sortWithinPartitions("fold", "block").mapInArrow(merged, "fold long, bits binary")
    maps = [np.zeros(bits // 8, np.uint8) for _ in range(DEPTH)]
    for r in durable(rows, "sketch").toLocalIterator():
        row, at = divmod(r["fold"], folds)
        maps[row][at * block_size // 8 : (at + 1) * block_size // 8] = np.frombuffer(r["bits"], np.uint8)
    return maps


def _steps(places: np.ndarray) -> bytes:
    """Sorted places in a block as 16-bit steps; a step of 65,535 goes that far and counts nothing."""
    step = np.diff(places, prepend=0)
    wide = step // 65535
    out = np.full(len(step) + wide.sum(), 65535, "<u2")
    out[np.cumsum(wide + 1) - 1] = step % 65535
    return out.tobytes()


def _places(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def _folded(fold: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fold], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["fold", "bits"])


def counts(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, k, f): the exact count of every phrase of 1 to `longest` words that occurs `least` times or more, and
    all words of a language as the phrase of k = 0.

    Phrases are words with a space between. docs: lang, text.
    """
    width = sketch_width(docs)
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, longest, least, width))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        mask = np.uint64(8 * len(maps[0]) - 1)
        for numbers, ids, begins in _parts(batches, longest):
            words = np.array(numbers.words, object)
            langs = np.array(numbers.langs, object)
            for k, at, rows in _cells(numbers, ids, begins, longest, width):
                if k == 1:
                    lang, n = np.unique(langs[ids[at]].astype(str), return_counts=True)
                    yield _counted(lang.tolist(), [b""] * len(lang), 0, n)
                passes = np.ones(len(at), bool)
                for held, row in zip(maps, rows, strict=True):
                    cell = row & mask
                    passes &= (held[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at = at[passes]
                key = np.zeros(len(at), np.int64)
                for j in range(k):
                    key = key << 21 | ids[at + j]
                key, n = np.unique(key, return_counts=True)
                parts = [key >> 21 * (k - 1 - j) & 0x1FFFFF for j in range(k)]
                phrase = words[parts[0]]
                for p in parts[1:]:
                    phrase = phrase + b" " + words[p]
                yield _counted(langs[parts[0]].tolist(), phrase.tolist(), k, n)

    rows = docs.select("lang", "text").mapInArrow(count, "lang string, phrase string, k int, f long")
    rows = rows.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    return durable(rows.where((F.col("k") == 0) | (F.col("f") >= least)), "phrases")


def _counted(langs: list[str], phrases: list[bytes], k: int, n: np.ndarray) -> pa.RecordBatch:
    columns = pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(n), k), pa.int32()), pa.array(n, pa.int64())
    return pa.RecordBatch.from_arrays(list(columns), names=["lang", "phrase", "k", "f"])


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, most: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's `most` best phrases of 2 to `longest` words.

    a counts the phrase, l and r the parts of its lowest-scoring cut (of equal ones the first), n all words of the
    language. A phrase is dropped if a longer one that is frequent too holds it and occurs at least `share` hundredths as
    often. Order: score and a descending, then the phrase by its bytes. A null lang is `und`, together with rows that say
    so; a null text is empty; repeated rows count each time; columns other than lang and text are not read; an empty table
    gives an empty table. `longest` is 2 or 3.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found = counts(docs, longest, least)
    found = found.withColumn("words", F.split("phrase", " "))
    whole = found.where("k >= 2")
    part = found.where("k >= 1").select("lang", F.col("phrase").alias("of"), F.col("f").alias("part_f"))
    # a row for each cut; both parts are frequent, since the whole is
    sides = lambda c: F.array_join(c, " ")
    cut = whole.select("lang", "phrase", F.col("f").alias("a"), "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", sides(F.slice("words", F.lit(1), F.col("cut"))).alias("head"), sides(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("tail"))
    cut = cut.join(part.withColumnsRenamed({"of": "head", "part_f": "l"}), ["lang", "head"]).join(part.withColumnsRenamed({"of": "tail", "part_f": "r"}), ["lang", "tail"])
    wide = lambda c: f"cast({c} as decimal(15,0))"
    score = F.expr(f"(cast({wide('a')} * {wide('a')} as decimal(31,0)) * cast(1000000 as decimal(7,0))) div ({wide('l')} * {wide('r')})")
    cut = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("of"))
    # what a longer candidate holds, with the longest one's count
    inner = whole.where("k > 2").select("lang", "f", "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", sides(F.slice("words", F.col("at"), F.col("size"))).alias("phrase")).agg(F.max("f").alias("held"))
    kept = cut.join(inner, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < share * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "of.l", "of.r", "of.score")
    # the best of each of many parts of a language, then the best of these
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= most)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    total = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return kept.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
