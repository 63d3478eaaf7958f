import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import mixing, packing, queries

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside, in any case.
DOCS = "doc_id long, text string, source string, size int, At int, slot string"
CLASHING = "doc_id long, text string, source string, _id int, _n int, _at int, of int, text_hash int, AT int, Slot int, place int, _slot int, src int, rid int"


def test_bound_and_packing_hold():
    @settings(max_examples=100, deadline=None)
    @given(st.lists(st.integers(1, 60), max_size=80))
    def check(lengths):
        x = np.array(lengths, np.int64)
        bins, offsets, n = packing.best_fit_decreasing(x, 60)
        assert packing.lower_bound(x, 60) <= n
        filled = np.bincount(bins, weights=x, minlength=n) if len(x) else np.zeros(0)
        assert (filled <= 60).all()
        for b in range(n):
            at = sorted((offsets[i], x[i]) for i in np.flatnonzero(bins == b))
            assert [o for o, _ in at] == [0, *np.cumsum([s for _, s in at])[:-1]]

    check()


def test_bound_needs_dual_feasible_functions():
    assert packing.lower_bound(np.array([51] * 10), 100) == 10  # the sum alone gives 6


def test_packing_is_whole(spark):
    from tokenizers import Tokenizer

    out = queries.op4_packing(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    tok = Tokenizer.from_file(queries.tokenizer_path())
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        mine = out[out.doc_id == doc_id].sort_values("piece")
        assert mine.start.tolist() == list(range(0, len(ids), 4096))
        import zlib

        assert mine.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()) for s in mine.start]
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]]
        assert seq.length.sum() <= 4096
    assert out.sequence_id.nunique() <= 1.02 * np.ceil(out.length.sum() / 4096) + 1


def test_partitions_exchange(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"doc_id": range(3000), "piece": 0, "start": 0, "length": rng.integers(1, 100, 3000), "ids_crc32": 0})
    out = packing.pack(spark.createDataFrame(frame), 100, partition_rows=300).toPandas()
    assert sorted(out.doc_id) == list(range(3000))
    assert out.groupby("sequence_id").length.sum().max() <= 100
    single = packing.best_fit_decreasing(frame.length.to_numpy(), 100)[2]
    assert out.sequence_id.nunique() <= 1.025 * single
    parts = out.drop_duplicates("part")
    assert parts.part_bins.sum() == out.sequence_id.nunique() and (parts.part_bound <= parts.part_bins).all()
    for _, part in out.groupby("part"):
        assert part.sequence_id.nunique() == part.part_bins.iloc[0] and packing.lower_bound(part.length.to_numpy(), 100) == part.part_bound.iloc[0]


def fewest(lengths, capacity):
    """The least number of bins, by trying every placement."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[k]}:
            left = list(rooms)
            left[left.index(room)] -= lengths[k]
            place(k + 1, left)
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_bound_and_packing_against_the_optimum(lengths):
    x = np.array(lengths, np.int64)
    best = fewest(sorted(lengths, reverse=True), 30)
    bound, used = packing.lower_bound(x, 30), packing.best_fit_decreasing(x, 30)[2]
    assert bound <= best <= used <= 1.5 * best
    assert bound != used or used == best


def test_every_packing_is_certified(spark):
    out = queries.op4_packing(spark, SF)
    sequences, bound = packing.certificate(out, 4096)
    parts = out.select("part", "part_bins", "part_bound").distinct().toPandas()
    assert sequences == parts.part_bins.sum() and bound <= sequences <= 1.02 * bound + 1
    assert (parts.part_bound <= parts.part_bins).all() and (parts.part_bound > 0).all()


def test_packing_edges(spark):
    rows = [(None, None, None, 1, 1, "x"), (1, "", "a", 1, 1, "x"), (1, "", "a", 1, 1, "x"), (2, "a " * 9000, "b", 1, 1, "x")]
    out = packing.pack_documents(spark.createDataFrame(rows, DOCS), queries.tokenizer_path()).toPandas()
    assert len(out) == 6 and out.length.sum() == 3 + 9001
    assert packing.pack_documents(spark.createDataFrame([], DOCS), queries.tokenizer_path()).count() == 0


def test_mixing_is_sql(spark):
    mine = queries.op10_mixing(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    sql = con.sql(queries.oracle_sql()["op10_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(mine, sql[mine.columns], check_dtype=False, check_exact=True)


def test_the_schedule_decides_the_mix(spark, monkeypatch):
    whole = queries.op10_mixing(spark, SF).toPandas()
    source = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").source
    near = whole.groupby(whole.doc_id.map(source)).agg({"taken": "sum", "target": "first"})
    assert (abs(near.taken - near.target) < 1).all() and (whole.first_slot.notna() == (whole.taken > 0)).all()
    full = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda sources, block: full(sources, block).where("slot % 2 = 0"))
    half = queries.op10_mixing(spark, SF).toPandas()
    assert 0.4 < half.taken.sum() / whole.taken.sum() < 0.6


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([("a", 60_000), ("b", 30_000), ("c", 10_000)], "src string, quota long")
    line = mixing.schedule(sources, 100).orderBy("slot").toPandas()
    assert line.slot.is_unique and line.groupby("src").block_no.apply(lambda x: x.is_monotonic_increasing).all()
    assert len(line) == 1000 and line.groupby("src").block_no.nunique().to_dict() == {"a": 600, "b": 300, "c": 100}
    for n in (50, 200, 700):
        assert abs((line.slot < n).mul(line.src == "a").sum() - 0.6 * n) < 8


@pytest.mark.parametrize("rows", [[], [(None, None, None, 1, 2, "x"), (1, "", None, 1, 2, "x"), (2, "a b", "s", 1, 2, "x"), (2, "a b", "s", 1, 2, "x"), (3, "c " * 5000, "t", 1, 2, "x")]])
def test_mixing_edges(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed(docs).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    assert whole.where(F.coalesce("text", F.lit("")) == "").count() == sum(not r[1] for r in rows)


def test_columns_may_have_any_name(spark):
    rows = [(k, "word " * 60, "ab"[k % 2], *range(11)) for k in range(40)]
    docs = spark.createDataFrame(rows, CLASHING)
    out = mixing.mixed_documents(docs, block=64)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {tuple(range(11))}
    assert mixing.mixed(docs, block=64).count() == 40


def test_mixed_documents_follow_the_schedule(spark):
    rows = [(k, "word " * 100, "abc"[k % 3], 1, 1, "x") for k in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed_documents(docs, block=100).toPandas()
    base, sources = mixing.prepare(docs, (3, 1, 2), 1.5, 2)
    pieces = mixing.mix(base, sources, 100).where("start_word = 0").toPandas()
    pieces = pieces.sort_values(["slot", "place"], na_position="last")
    assert sorted(out.doc_id) == sorted(pieces.doc_id) and out.source.tolist() == pieces.source.tolist()
    shares = out.source.value_counts(normalize=True)
    for n in (60, 300, 700):
        for source, part in out.source[:n].value_counts(normalize=True).items():
            assert abs(part - shares[source]) < 8 / n
