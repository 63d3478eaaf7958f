"""Embeddings, pages and conversations: brute force, SQL, round trips and odd tables."""

import hashlib
import json
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import ann, chat, embedding_dedup, html_extract, queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, id string, x int, copies int, dim string, cell int"
ODD = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5]


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if a is None else float(a) for a in v], label, "x", 1, 1, "x", 1) for i, v, label in rows], VECTORS)


def clustered(n=300, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    x = centres[rng.integers(0, 20, n)] + 0.12 * rng.standard_normal((n, dim))
    x[::7] = x[3]  # copies
    x[5] = 1e-30 * x[4]
    return x.astype(np.float32)


def same_as_sql(spark, name):
    mine = getattr(queries, name)(spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql = con.sql(queries.oracle_sql()[name]).df()[mine.columns]
    key = list(mine.columns[:2])
    assert mine.sort_values(key).to_numpy().tolist() == sql.sort_values(key).to_numpy().tolist()


@pytest.mark.parametrize("name", ["op2_embeddings", "op7_chat", "op9_neighbours"])
def test_is_sql(spark, name):
    same_as_sql(spark, name)


def cosines(x):
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x @ x.T


def test_embedding_links_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    x = clustered()
    label = np.arange(len(x)) // 3 % 2
    rows = [(k, v, int(lab)) for k, (v, lab) in enumerate(zip(x, label, strict=True))]
    rows += [(1000 + k, v, 0) for k, v in enumerate(ODD)] + [(2000, x[0], None), (2001, [1.0, 0.0], 0), (2002, [1.0, 0.0], 0)]
    out = embedding_dedup.near_duplicates(vectors_of(spark, rows)).toPandas().set_index("vec_id")
    linked = (cosines(x) >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    assert out.n_links.loc[range(len(x))].tolist() == linked.sum(axis=1).tolist()
    reach = np.eye(len(x), dtype=bool) | linked
    for _ in range(12):
        reach = reach | (reach @ reach)
    assert out.component_id.loc[range(len(x))].tolist() == reach.argmax(axis=1).tolist()
    assert (out.kept == (out.index == out.component_id)).all()
    assert out.n_links.loc[1000:2000].sum() == 0 and out.n_links.loc[2001:].tolist() == [1, 1]


def test_embedding_edges(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    out = embedding_dedup.near_duplicates(vectors_of(spark, rows)).toPandas()
    assert sorted(out.n_links) == [0, 3, 3, 3, 3] and set(out[out.n_links == 3].component_id) == {7}
    assert embedding_dedup.near_duplicates(vectors_of(spark, [])).count() == 0
    assert embedding_dedup.near_duplicates(vectors_of(spark, [(k, v, 1) for k, v in enumerate(ODD)])).where("kept and n_links = 0").count() == len(ODD)


def test_threshold_is_decided_on_original_vectors(spark):
    triples = [(1, 2, 2, 3), (2, 3, 6, 7), (1, 4, 8, 9), (4, 4, 7, 9), (2, 6, 9, 11), (6, 6, 7, 11), (3, 4, 12, 13), (2, 5, 14, 15)]
    rows, n = [], 0
    for a, b, c, _ in triples:  # (1, 0, 0, 0) and (49, x, y, z) with x^2 + y^2 + z^2 = 99
        for label in range(4):
            scale = float(3 ** (n % 5)) / 7
            rows += [(2 * n, [scale, 0.0, 0.0, 0.0], n), (2 * n + 1, [49 * scale * a, 9 * scale * a, 3 * scale * a, 3 * scale * a], n)]
            n += 1
    rows += [(1000, [1e-200, 0.0, 0.0, 0.0], 5000), (1001, [49e-200, 9e-200, 3e-200, 3e-200], 5000), (1002, [1.0, 0.3, 0.0, 0.0], 5000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = embedding_dedup.near_duplicates(frame).toPandas().set_index("vec_id").n_links
    for k in range(n):
        a, b = np.array(rows[2 * k][1]), np.array(rows[2 * k + 1][1])
        dot = lambda x, y: float(embedding_dedup.dots(x[None], y[None])[0])
        want = dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))) >= 0.98
        assert out[2 * k] == out[2 * k + 1] == want
    whole = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], 1), (2, [49.0, 9.0, 3.0, 3.0], 1)], frame.schema)
    assert embedding_dedup.near_duplicates(whole).toPandas().n_links.tolist() == [1, 1]


def test_one_id_may_stand_for_two_vectors(spark):
    rows = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [1.0, 0.001], 1), (8, [1.0, 0.001], 1)]
    out = embedding_dedup.near_duplicates(vectors_of(spark, rows)).toPandas()
    assert sorted(zip(out.vec_id, out.n_links, out.component_id, strict=True)) == [(7, 0, 7), (7, 2, 7), (8, 2, 7), (8, 2, 7)]


def test_tiny_vectors_have_cosines(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2e200]), (2, [1.0, 0.0]), (2, [1.0, 0.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).toPandas()
    assert out.vec_id.tolist() == [1, 2, 2] and np.allclose(out.score, [1, 1 / 5**0.5, 1 / 5**0.5])


def test_bounds_hold_and_prune():
    x = embedding_dedup.unit(clustered(400, 24).astype(np.float64))
    order = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j = embedding_dedup.compare(x, x, order, 0.98, True)
    want = np.argwhere(np.triu(x @ x.T >= 0.98, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(0)
    x, q = embedding_dedup.unit(rng.standard_normal((2000, 64))), embedding_dedup.unit(rng.standard_normal((20, 64)))
    coder = ann.Coder(64, 256)
    turn = coder.rotation()
    assert np.allclose(turn.T @ turn, np.eye(64))
    codes, scalars = coder.encode(x, turn)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    planes = coder.planes(q, turn)
    inside = []
    for n in range(20):
        guess, error = coder.estimate(codes, ones, scalars, *(p[n] for p in planes))
        inside.append(np.abs(guess - x @ q[n]) <= error)
        assert np.corrcoef(guess, x @ q[n])[0, 1] > 0.9
    assert np.mean(inside) > 0.995


def test_nearest_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 64)
    monkeypatch.setattr(ann, "ASKED", 8)
    x = clustered(600, 16)
    rows = [(k, v, 0) for k, v in enumerate(x)] + [(10_000 + k, v, 0) for k, v in enumerate(ODD)] + [(None, x[0], 0)]
    out = ann.nearest(vectors_of(spark, rows), F.col("vec_id") % 10 == 0).toPandas()
    assert out.groupby("query_id").size().eq(5).all() and out.query_id.nunique() == 60
    s = cosines(x)
    hits = 0
    for q, g in out.groupby("query_id"):
        s[q, q] = -2
        best = np.sort(s[q])[::-1][:5]
        hits += (np.abs(np.sort(g.score)[::-1] - best) < 1e-9).sum()
    assert hits / len(out) >= 0.99
    copies = [k for k in range(0, 600, 7)]
    near = out[out.query_id == 0].sort_values("rank")
    assert set(near.vec_id) <= {3, *copies} and near.vec_id.tolist() == sorted(near.vec_id)
    few = ann.nearest(vectors_of(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)]), F.col("vec_id") == 0).toPandas()
    assert few[["query_id", "rank", "vec_id"]].to_numpy().tolist() == [[0, 1, 1]]
    assert ann.nearest(vectors_of(spark, []), F.col("vec_id") == 0).count() == 0


PARTS = {
    "nav": "<nav><ul><li><a href='/a'>Menu words</a></li></ul></nav>", "header": "<header><p>Site words, here.</p></header>", "footer": "<footer>Foot words.</footer>",
    "aside": "<aside><p>Side words, long enough to be text.</p></aside>", "ad": "<div class='ad'>Buy words. Now, cheap.</div>", "form": "<form><p>Sign words.</p><input></form>",
    "notice": "<div class='cookie-notice'><p>Cookie words, please accept.</p></div>", "script": "<script>var a='<p>code words</p>';</script>", "style": "<style>p{words}</style>", "comments": "<section id='comments'><article><p>Reader words.</p></article></section>",
}


def test_pages_keep_the_article_only():
    random.seed(2)
    for _ in range(60):
        paragraphs = [" ".join(random.choices(["alpha", "beta,", "gamma.", "d&amp;e"], k=random.randint(1, 60))) for _ in range(random.randint(1, 8))]
        before, after = random.sample(list(PARTS.values()), 4), random.sample(list(PARTS.values()), 4)
        inner = random.choice(["", PARTS["ad"], PARTS["aside"], PARTS["form"]])
        body = "".join(f"<p>{p}" + random.choice(["</p>", "", "<br>"]) for p in paragraphs)
        html = f"<!DOCTYPE html><html><head><title>no words</title></head><body>{''.join(before)}<article><h1>The  head</h1>{body}{inner}</article>{''.join(after)}"
        assert html_extract.extract(html) == "\n".join(["The head", *(p.replace("&amp;", "&") for p in paragraphs)])


def test_pages_without_a_marked_article():
    text = "A long paragraph, with commas, and several sentences. It goes on; it has more."
    html = f"<div class='wrapper sidebar-layout'><ul><li><a href=1>Home</a><li><a href=2>About us</a></ul><div id=story><h2>Head</h2><p>{text}</p><p>{text}</p><p>Short.</p></div>{PARTS['ad']}</div>"
    assert html_extract.extract(html) == f"Head\n{text}\n{text}\nShort."


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-='\"ab p&;#1", max_size=60))
def test_no_page_is_too_broken(html):
    html_extract.extract(html)
    html_extract.extract(f"<article>{html}")


def test_page_edges(spark):
    rows = [(None, None, None), (1, None, ""), (1, None, ""), (2, "u", "<article>" + "<p>w</p>" * 20_000), (3, "u", "<b>" * 3000 + "deep"), (4, "u", "&" * 50_000), (5, "u", "<div>" * 50_000 + "</p></li>" * 50_000), (6, "u", "<a href='" * 20_000)]
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, text string, n_chars int")
    out = html_extract.main_text(pages).toPandas()
    assert len(out) == 8 and (out.n_chars == out.text.str.len()).all() and out.text[3] == "\n".join(["w"] * 20_000)
    assert html_extract.main_text(pages.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="us\\n\n<|er", max_size=8), st.text(alphabet="<|\\im_start>end\n x", max_size=40)), max_size=5))
def test_formatting_is_reversible(turns):
    whole = "".join(f"{chat.START}{chat._role_line(r)}\n{chat.escape(t)}{chat.END}\n" for r, t in turns)
    assert chat.read_segments(whole) == turns


def test_layouts_meet_in_canonical_turns(spark):
    said = [("user", "hi"), ("assistant", "<|im_end|>yo")]
    records = [
        {"messages": [{"role": r, "content": t} for r, t in said]}, {"conversations": [{"from": "human", "value": "hi"}, {"value": "<|im_end|>yo", "from": "gpt"}]},
        {"instruction": "hi", "input": "", "output": "<|im_end|>yo"}, {"completion": "<|im_end|>yo", "prompt": "hi"}, {"question": "hi", "answer": "<|im_end|>yo"},
    ]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(90, None), (91, "no json"), (92, '{"other": 1}'), (93, "[1]")]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string"))
    good = turns.where("role is not null").toPandas()
    for k in range(len(records)):
        assert [tuple(x) for x in good[good.conv_id == k].sort_values("turn")[["role", "text"]].to_numpy()] == said
    assert turns.where("role is null").count() == 4 and good.layout.nunique() == len(records)
    out = chat.digests(chat.formatted(turns)).toPandas()
    want = hashlib.sha256(b"user\nhi\nassistant\n<|im_end|>yo\n").hexdigest()
    assert set(out.turns_sha256) == {want} and set(out.loss_chars) == {len("<|im_end|>yo")} and len(out) == len(records)


#: Records as data holds them, and the turns that they give.
LOOSE = [
    ({"conv_id": 1, "turn": "1", "role": "user", "text": "a"}, [(1, "user", "a")]),
    ({"conv_id": 1, "turn": True, "role": "user", "text": "a"}, [(None, "user", "a")]),
    ({"conv_id": 1, "turn": 2.0, "role": "user", "text": 7}, [(2, "user", "7")]),
    ({"conv_id": 1, "turn": 10**30, "role": None, "text": None}, [(None, "", "")]),
    ({"turn": "3", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [(3, "user", "a"), (4, "assistant", "b")]),
    ({"messages": ["hello", {"role": "user", "content": "a"}, None, 3]}, [(0, "", "hello"), (1, "user", "a"), (2, "", ""), (3, "", "3")]),
    ({"messages": ["a", "b"]}, [(0, "", "a"), (1, "", "b")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [(0, "system", "s"), (1, "user", "a"), (2, "assistant", "b")]),
    ({"prompt": "p", "messages": [{"role": "assistant", "content": "b"}]}, [(0, "user", "p"), (1, "assistant", "b")]),
    ({"prompt": "p", "messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "b"}]}, [(0, "user", "p"), (1, "assistant", "b")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, "c", {"type": "image", "url": "u"}]}]}, [(0, "user", 'a\nb\nc\n{"type": "image", "url": "u"}')]),
    ({"instruction": "i", "input": "n", "output": "o", "system": "s"}, [(0, "system", "s"), (1, "user", "i\nn"), (2, "assistant", "o")]),
    ({"messages": [], "system": "s"}, [(0, "system", "s")]),
    ({"messages": {"role": "user", "content": "a"}}, None),
    ({"messages": []}, None),
]


def test_what_real_records_hold_is_no_error(spark):
    rows = [(k, json.dumps(r)) for k, (r, _) in enumerate(LOOSE)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string"))
    found = {}
    for r in turns.collect():
        found.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    for k, (record, want) in enumerate(LOOSE):
        assert sorted(found[k], key=repr) == sorted(want or [(None, None, None)], key=repr), record
    assert chat.unknown_layouts(turns).agg(F.sum("records")).first()[0] == 1  # the empty list is known, and told apart
    assert [r.conv_id for r in turns.where(F.startswith("layout", F.lit(chat.EMPTY))).collect()] == [14]
    digests = chat.digests(chat.formatted(turns)).collect()
    assert len(digests) == len(LOOSE) - 2


def test_records_come_in_several_layouts(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    read = chat.canonical_turns(chat.turn_records(turns))
    assert read.select("layout").distinct().count() == 3 and read.where("role is null").count() == 0
    whole = turns.selectExpr("conv_id", "turn", "coalesce(role, '') role", "coalesce(text, '') text")
    assert whole.exceptAll(read.drop("layout")).isEmpty() and read.drop("layout").exceptAll(whole).isEmpty()


def test_further_fields_do_no_harm(spark):
    records = [{"instruction": "hi", "input": "", "output": "yo", "id": 7}, {"messages": [{"role": "user", "content": "hi", "name": "x"}], "source": "s"}, {"prompt": "a", "completion": "b", "response": "c"}, {"id": 7}]
    turns = chat.canonical_turns(spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "conv_id long, record string"))
    got = [tuple(r) for r in turns.where("role is not null").orderBy("conv_id", "turn").select("conv_id", "role", "text").collect()]
    assert got == [(0, "user", "hi"), (0, "assistant", "yo"), (1, "user", "hi")]
    assert sorted(r.records for r in chat.unknown_layouts(turns).collect()) == [1, 1]


def test_chat_edges(spark):
    rows = [(None, 1, "user", "a"), (None, 0, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (1, None, "user", "first"), (2, 0, "assistant", "z" * 300_000)]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, layout string, segment int")
    out = chat.digests(chat.formatted(chat.canonical_turns(chat.turn_records(turns)))).toPandas().set_index("conv_id")
    assert out.n_turns.loc[1] == 3 and out.loss_chars.loc[2] == 300_000 and len(out) == 3
    assert out.turns_sha256.loc[1] == hashlib.sha256(b"user\nfirst\nassistant\n\nassistant\n\n").hexdigest()
    assert chat.digests(chat.formatted(chat.canonical_turns(chat.turn_records(turns.limit(0))))).count() == 0


def test_path_ratios_decide_beside_a_marked_article():
    text = "A long paragraph, with commas, and several sentences. It goes on; it has more. " * 4
    html = f"<nav><a href=1>Home</a></nav><div id=story><h2>Head</h2><p>{text}</p><p>{text}</p></div><article><p>A teaser.</p></article>{PARTS['ad']}{PARTS['footer']}"
    assert html_extract.extract(html).split("\n") == ["Head", text.strip(), text.strip(), "A teaser."]


def test_marks_lower_a_score_but_drop_no_long_text():
    text = "A long paragraph, with commas, and several sentences. It goes on; it has more. " * 3
    body = text.strip()
    for inner in (
        f"<section id='discussion'><h2>Words</h2><p>{text}</p></section>", f"<h2 id='related-work'>Words</h2><p>{text}</p>", f"<h2>Words</h2><p id='search-results'>{text}</p>",
        f"<h2>Words</h2><div class='notice'><p>{text}</p></div>", f"<h2>Words</h2><p><span class='share'>{text[:20]}</span>{text[20:]}</p>",
    ):
        page = f"{PARTS['nav']}<article><h1>Head</h1><p>{text}</p>{inner}{PARTS['ad']}</article>{PARTS['notice']}{PARTS['comments']}"
        assert html_extract.extract(page).split("\n") == ["Head", body, "Words", body], inner
    assert html_extract.extract(f"<p>Short</p>{PARTS['ad']}") == "Short"


def slow_select(found):
    """The choice of blocks, written out path by path."""
    from math import exp, expm1, log1p

    keys = list(dict.fromkeys(b.key for b in found))
    of = {k: [b for b in found if b.key == k] for k in keys}
    outside = lambda b: not b.inside or b.outside or b.marked
    linky = {k for k in keys if sum(map(outside, of[k])) > 1 and sum(b.linked for b in of[k]) > 0.8 * sum(len(b.text) for b in of[k])}
    keys = [k for k in keys if k not in linky]
    text, marks, raw = [], [], {}
    for k in keys:
        whole = 0
        for b in of[k]:
            linked = min(b.linked, len(b.text))
            whole += len(b.text) - linked * (0.75 if b.inside and not b.outside else 1)
        points = sum(c in ".,;:!?。，；：！？、" for b in of[k] for c in b.text)
        text.append(log1p(whole / len(of[k])))
        marks.append(log1p(points / len(of[k])))
        raw[k] = (whole / len(of[k])) * (1 + points / len(of[k]))
    bell = [exp(-0.5 * d * d) for d in range(-2, 3)]

    def smooth(x):
        at = lambda k: x[k] if 0 <= k < len(x) else 0
        return [0.75 * x[k] + 0.25 * sum(w * at(k + d) for w, d in zip(bell, range(-2, 3), strict=True)) / sum(bell) for k in range(len(x))]

    scores = {}
    for k, st, sm in zip(keys, smooth(text), smooth(marks), strict=True):
        b = of[k][-1]
        factor = 1 / 9 if b.outside or b.marked else 9 if b.inside else 1
        if any(b.inside and b.marked and not b.outside for b in of[k]) and raw[k] >= 400:
            factor = 9
        scores[k] = log1p(expm1(st) * exp(sm) * factor)
    if not scores:
        return []
    line = sorted(scores.values())
    spread = min(np.std(line), line[-1])
    apart = lambda k: k * (len(line) - k) * (sum(line[:k]) / k - sum(line[k:]) / (len(line) - k)) ** 2
    cut = max(range(1, len(line)), key=lambda k: round(apart(k), 9), default=0)
    parted = max(spread, line[cut] if cut else 0)
    least = log1p(400 / 9)
    inside = {b.key for b in found if b.inside}
    good = {k for k, s in scores.items() if s >= (max(parted, least) if k[1] or k[2] else spread if k in inside else parted)}
    beside = {b.parent for k in good for b in of[k]}
    head = lambda b: b.leaf[:1] == "h" and b.leaf[1:2] in set("123456") and b.leaf[2:3] in ("", ".")
    return [b for b in found if b.key in scores and (b.key in good or (head(b) and b.parent in beside and not b.outside and not b.marked))]


LONG_TEXT = "A long sentence of a reader, with commas, and with stops. " * 12
#: Parts that are no part of an article, inside of one and beside it, however long.
NEVER = (
    "<section id='comments'><h3>Said</h3><p>{}</p></section>", "<div class='comments'><p>{}</p></div>", "<ol class='comment-list'><li><p>{}</p></li><li>{}</li></ol>", "<div class='ad'><p>{}</p></div>",
    "<div class='content-ads'>{}</div>", "<p class='ad-slot lead'>{}</p>", "<article class='comment'><p>{}</p></article>", "<div id='disqus_thread'><p>{}</p></div>",
)


@pytest.mark.parametrize("part", NEVER)
def test_comments_and_adverts_go_however_long(part):
    story = "".join(f"<p>Paragraph {k} of the story, which says something, and ends.</p>" for k in range(6))
    for said in (LONG_TEXT, "Short."):
        odd = part.replace("{}", said)
        want = html_extract.extract(f"<html><body><article><h1>Head</h1>{story}</article></body></html>")
        assert want.count("\n") == 6
        for page in (f"<article><h1>Head</h1>{story}{odd}</article>", f"<article><h1>Head</h1>{odd}{story}</article>", f"<article><h1>Head</h1>{story}</article>{odd}"):
            assert html_extract.extract(f"<html><body>{page}</body></html>") == want, page
        assert html_extract.extract(f"<html><body><div><h1>Head</h1>{story}</div>{odd}</body></html>") == want


def test_a_frame_around_the_article_is_no_advert():
    story = "<h1>Head</h1>" + "<p>Of comments, ads and replies, a story that says something.</p>" * 4
    for name in ("content-ads", "page ad-container", "has-ads"):
        assert html_extract.extract(f"<body><div class='{name}'><main>{story}</main></div></body>").count("\n") == 4, name
    assert html_extract.extract(f"<body><article>{story}<h2 id='comment-on-method'>Kept</h2><section id='discussion'><p>Said, and kept, too.</p></section></article></body>").count("\n") == 6


def test_ratios_part_paths_that_nothing_else_tells_apart():
    """Plain divs without a region or a mark: long, punctuated paths are the text, and with the lengths exchanged the others are."""
    long, short = "Words that go on, and on, until they stop. " * 9, "Few words"
    page = lambda a, b: "<body><div><h1>Head</h1>" + f"<p>{a}</p>" * 5 + "</div><div>" + f"<div>{b}</div>" * 5 + "</div></body>"
    for text in (html_extract.extract(page(long, short)), html_extract.extract(page(short, long))):
        assert text.split("\n")[1:] == [long.strip()] * 5


def test_selection_is_brute_force(spark):
    for (page,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        found = html_extract.blocks(page or "")
        assert html_extract.select(found) == slow_select(found)
    random.seed(8)
    kinds = ["<p>{}</p>", "<div class=ad>{}</div>", "<ul><li><a href=1>{}</a><li><a>{}</a></ul>", "<h2>{}</h2>", "<article><p>{}</p><p class=share>{}</p></article>", "<nav>{}</nav>", "<div id=story><p>{}</p></div>"]
    for _ in range(300):
        text = lambda: " ".join(random.choices(["alpha", "beta,", "gamma.", "delta"], k=random.choice([1, 8, 90])))
        page = "".join(k.replace("{}", text()) for k in random.choices(kinds, k=random.randint(1, 9)))
        found = html_extract.blocks(page)
        assert html_extract.select(found) == slow_select(found), page


def test_scores_decide_what_pages_give(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    before = [html_extract.extract(p) for p in pages]
    # were all paths to score high and alike, whatever is marked would come in too
    monkeypatch.setattr(html_extract, "path_scores", lambda found: {b.key: 10.0 for b in found})
    assert sum(html_extract.extract(p) != b for p, b in zip(pages, before, strict=True)) > 0.9 * len(pages)


def test_marks_of_holders_and_lists_of_links():
    text = "A long paragraph, with commas, and several sentences. It goes on; it has more. " * 3
    body, article = text.strip(), f"<article><h1>Head</h1><p>{text}</p><ul><li><a href=1>First, a work of 1999</a><li><a href=2>Second, a work of 2001</a></ul></article>"
    want = ["Head", body, "First, a work of 1999", "Second, a work of 2001"]
    for other in ("<div class='ad-container'><p>Buy words, now.</p></div>", "<div class='comments-wrapper'><p>Reader words.</p></div>", "<div class='sidebar column'><p>Side words.</p></div>"):
        for page in (f"{other}{article}", f"{article}{other}", f"<div class='page wrapper'>{article}{other}</div>", f"<div class='row sidebar-left'>{article}</div>{other}"):
            assert html_extract.extract(page).split("\n") == want, page
    assert html_extract.extract(f"<article><h1>Head</h1><p class='social-history'>{text}</p><p>It holds that <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p></article>").split("\n") == ["Head", body, "It holds that x=1."]


def test_unclosed_elements_cut_nothing():
    for broken in ("<svg viewBox='0 0 1 1'/>", "<svg/>", "<video src=a>", "<object data=a>", "<select>", "<video><video>no</video>"):
        for after in ("", "<svg><text>no</text></svg>"):
            assert html_extract.extract(f"<article><p>One.</p>{broken}<p>Two.</p>{after}<p>Three.</p></article>").split("\n") == ["One.", "Two.", "Three."], broken
    assert html_extract.extract("<article><p>One.</p><object>no<object>no</object>no</object><p>Two.</p></article>") == "One.\nTwo."
