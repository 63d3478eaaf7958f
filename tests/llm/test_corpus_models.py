"""Phrases, language-model scores and ranked search: brute force, odd tables, and the models' own parts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import lm_scoring, phrases, queries, ranked_search

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names the operators use inside.
DOCS = "doc_id long, text string, lang string, row long, term int, score string, word string, k int, rank int, item long"
ODD = [(None, None, None), (None, "alpha beta", "en"), (None, "alpha beta", "en"), (1, "", "en"), (2, " \t\n ", None), (3, "ALPHA beta. İstanbul \U0001f600 x-y_z 7\x00q", "en")]
ODD += [(4, "x " * 30_000, "fr"), (5, "w" * 100_000, "fr"), (6, ".;,\n", "en"), (6, "gamma", "en"), (7, "alpha beta", None)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, 1, "x", "x", 1, 1, 1) for i, t, g in rows], DOCS)


def real(spark, columns=("doc_id", "text", "lang")):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*columns).collect()]


# --- ranked search


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def slow_ranked(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t, *_ in docs]
    n, length = sum(m > 0 for _, _, m in held), sum(m for _, _, m in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c, m in held:
            norm = 100 - 50 + (50 * m * n) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * norm)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("tiers", [(256, 4096), (4, 16), (1,)])
def test_search_is_brute_force_by_any_tiers(spark, tiers):
    docs = real(spark) + [*ODD, (900, "alpha beta gamma", "en"), (901, "alpha beta gamma", "en")]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(-1, "Alpha beta"), (-1, "Alpha beta"), (-1, "gamma"), (None, "alpha"), (-2, None), (-3, "?!"), (-4, "nowhere to be found zzzz")]
    found = ranked_search.ranked(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 50, tiers)
    mine = [(r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()]
    assert sorted(mine, key=repr) == sorted(slow_ranked(docs, items, 50), key=repr)
    if tiers[0] == 256:
        assert {r.tier for r in found.select("tier").collect()} == {0}


def test_items_fall_through_to_the_last_tier(spark):
    """One common term in documents of many lengths: no cut of a small tier can prove the 50 best."""
    docs = [(k, "common " + " ".join(f"w{k}x{j}" for j in range(k % 7)), "en") for k in range(400)]
    items = spark.createDataFrame([(1, "common"), (2, "w3x1 common")], "item_id long, text string")
    found = ranked_search.ranked(docs_of(spark, docs), items, 50, (8,))
    assert {r.tier for r in found.where("item_id = 1").collect()} == {1}
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect())) == sorted(slow_ranked(docs, [(1, "common"), (2, "w3x1 common")], 50))


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked_search.ranked(docs_of(spark, []), items).count() == 0
    assert ranked_search.ranked(docs_of(spark, ODD), items.limit(0)).count() == 0


# --- phrases


def slow_phrases(rows, least=10, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        some = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        held = {}
        for p, c in some.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    held[part] = max(c, held.get(part, 0))
        kept = []
        for p, a in some.items():
            if 100 * held.get(p, -1) >= 50 * a:
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(kept)[:most])]
    return sorted(out)


def mine_phrases(found):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


def test_phrases_are_brute_force(spark):
    rows = real(spark) + ODD + [(100 + k, f"new york city, {'new york' if k % 3 else 'york'} Élan. a\x1cb c\xa0d " * 3, None if k % 2 else "und") for k in range(12)]
    assert mine_phrases(phrases.collocations(docs_of(spark, rows))) == slow_phrases(rows)
    found = phrases.collocations(docs_of(spark, rows), least=3, most=7)
    assert mine_phrases(found) == slow_phrases(rows, 3, 7)


def test_query_of_phrases_is_brute_force(spark):
    assert mine_phrases(queries.op11_phrases(spark, SF)) == slow_phrases(real(spark))


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, ODD[:1])).count() == 0


def test_long_texts_are_taken_in_turns(monkeypatch):
    """Turns of few words, and numbers that run out, count what one turn counts."""
    words = [f"w{k % 37}" if k % 11 else "." for k in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fr", "en"]), pa.array([" ".join(words), " ".join(words[:50]), None])], names=["lang", "text"])

    def counted():
        found = Counter()
        for numbers, ids, begins in phrases._parts(iter([batch]), 3):
            for k, at in phrases._grams(ids, begins, 3):
                found.update((numbers.langs[ids[a]], *(numbers.words[x] for x in ids[a : a + k])) for a in at)
        return found

    whole = counted()
    assert sum(whole.values()) > 10_000
    for part, most in ((64, 1 << 20), (7, 60)):
        monkeypatch.setattr(phrases, "PART", part)
        monkeypatch.setattr(phrases, "WORDS", most)
        assert counted() == whole


def test_steps_of_cells_come_back():
    rng = np.random.default_rng(0)
    for places in (rng.integers(0, phrases.BLOCK, 3000), np.array([0, 0, 65535, 65535, 131070, 400_000, phrases.BLOCK - 1]), np.array([phrases.BLOCK - 1])):
        places = np.sort(places)
        assert np.array_equal(phrases._places(np.frombuffer(phrases._steps(places), "<u2")), places)


def test_sketch_passes_all_that_is_frequent(spark):
    rows = [(k, "one two three four " * 5 + f"rare{k} once{k}", "en") for k in range(30)]
    docs = docs_of(spark, rows).select("lang", "text")
    width = phrases.sketch_width(docs)
    maps = phrases.sketch(docs, 3, 10, width)
    assert len(maps) == phrases.DEPTH and all(8 * len(m) == min(width, phrases.MOST_BITS) for m in maps)
    numbers, ids, begins = next(phrases._parts(iter([pa.RecordBatch.from_arrays([pa.array(["en"] * 30), pa.array([t for _, t, _ in rows])], names=["lang", "text"])]), 3))
    n = Counter()
    for k, at, cells in phrases._cells(numbers, ids, begins, 3, width):
        for a, cell in zip(at, cells.T, strict=True):
            passes = all(m[c >> np.uint64(3)] >> np.uint8(c & np.uint64(7)) & 1 for m, c in zip(maps, cell, strict=True))
            rare = any(numbers.words[x].startswith((b"rare", b"once")) for x in ids[a : a + k])
            assert passes or rare
            n[rare, passes] += 1
    assert n[False, True] > 1000 and n[True, True] <= 0.05 * n[True, False]


# --- language model


def slow_base(docs):
    words = [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) + [""] for _, t, *_ in docs]
    out = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for (i, *_), ws in zip(docs, words, strict=True) if out(i) is False for w in ws)
    n = sum(c.values())
    return [(i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in ws)) for (i, *_), ws in zip(docs, words, strict=True)]


def test_base_scores_are_brute_force(spark, monkeypatch):
    docs = real(spark) + ODD
    want = sorted(slow_base(docs), key=repr)
    by_heart = sorted(map(tuple, lm_scoring.scores(docs_of(spark, docs), queries.tokenizer_path()).collect()), key=repr)
    monkeypatch.setattr(lm_scoring, "MOST_WORDS", 100)  # nearly all words by the join
    joined = sorted(map(tuple, lm_scoring.scores(docs_of(spark, docs), queries.tokenizer_path()).collect()), key=repr)
    for mine in (by_heart, joined):
        assert [m[:5] for m in mine] == [w[:5] for w in want]
        assert [m[5] for m in mine] == pytest.approx([w[5] for w in want], rel=1e-9)
        assert all(m[6] < 0 and math.isfinite(m[6]) for m in mine)
    assert [m[6] for m in by_heart] == [m[6] for m in joined]  # training and scores are the same again


def test_nothing_to_learn_from(spark):
    path = queries.tokenizer_path()
    assert lm_scoring.scores(docs_of(spark, []), path).count() == 0
    (row,) = lm_scoring.scores(docs_of(spark, [(None, "one two", "en")]), path).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (None, 3, 0, 0, 0.0) and row.score < 0


@pytest.fixture(scope="module")
def model():
    """A tree, weights off their start, and texts of ids."""
    rng = np.random.default_rng(2)
    tree = lm_scoring.Tree((1e6 / np.arange(1, 4001)).astype(np.int64))
    w = {k: x + (0.3 * rng.standard_normal(x.shape)).astype(np.float32) for k, x in tree.weights().items()}
    return tree, w, [rng.choice(4000, n, p=(p := 1 / np.arange(1, 4001)) / p.sum()) for n in (1, 15, 16, 17, 33, 200)]


def slow_logs(tree, w, ids):
    """Natural-log probabilities of every id at each place of a text, one place at a time."""
    inputs = [tree.start, *tree.local[ids[:-1]]]
    out = []
    for t in range(len(ids)):
        first = max(0, t // lm_scoring.BLOCK * lm_scoring.BLOCK - lm_scoring.BLOCK)
        seen = w["embed"][inputs[first : t + 1]].astype(float)
        inside, o = lm_scoring.WIDTH // lm_scoring.HEADS, []
        for j in range(lm_scoring.HEADS):
            q, k, v = ((seen @ w[n])[:, j * inside : (j + 1) * inside] for n in ("query", "key", "value"))
            s = np.exp(q[-1] @ k.T / math.sqrt(inside) + w["near"][j][np.arange(len(seen))[::-1]])
            o.append(s / s.sum() @ v)
        r = seen[-1] + np.concatenate(o) @ w["mix"]
        h = r + np.maximum(r @ w["up"] + w["up_bias"], 0) @ w["down"]
        logs = lambda x: x - np.log(np.exp(x).sum())
        top = logs(h @ w["first"] + w["first_bias"])
        inner = [logs(h @ a + b) for a, b in zip(w["inner"], w["inner_bias"], strict=True)]
        known = np.concatenate([top[: lm_scoring.TOP], *(top[lm_scoring.TOP + c] + x for c, x in enumerate(inner))])
        out.append(np.where(tree.local < len(known), known[np.minimum(tree.local, len(known) - 1)], top[-1] + tree.log_rest))
    return np.array(out)


def test_each_id_is_scored_once_by_its_own_context(model):
    tree, w, texts = model
    mine = lm_scoring.Scorer(w, tree)(texts)
    want = []
    for ids in texts:
        logs = slow_logs(tree, w, ids)
        assert np.exp(logs).sum(axis=1) == pytest.approx(np.ones(len(ids)), rel=1e-4)  # a distribution over all ids
        want.append(logs[np.arange(len(ids)), ids].sum() / math.log(10))
    assert mine == pytest.approx(want, rel=1e-4)


def test_words_encoded_together_are_the_tokenizers_own():
    path = queries.tokenizer_path()
    words = "the the, don't 'tis a.b x-y. été, ÉTÉ straße! İx 日本語 42 4th. <|endoftext|> end<|x naïve?! ... ,".split() + ["w" * 70, "q" * 63 + "!" * 40, "tab\x1esign", "ﬁ", "ß", "a" + "!" * 33]
    words = [w.encode().translate(lm_scoring._LOWER) for w in dict.fromkeys(words)] + [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}{'.' * (k % 3)}".encode() for k in range(600)]
    words = list(dict.fromkeys(words))
    table = lm_scoring.WordTable(path, {b"the": -1.0})
    for _ in range(2):
        ids, size, logs = table(words)
        want = [np.frombuffer(x, "<u4").tolist() for x in lm_scoring.WordTokens(path).encode(words)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want
        assert logs[words.index(b"the")] == -1.0 and np.isnan(logs).sum() == len(words) - 1
    table.limit = 10
    ids, size, _ = table([b"new", *words[:20]])
    assert np.array_equal(ids[size[0] :], np.concatenate(want[:20])) and len(table.number) == 21


def test_slices_do_not_matter(model, monkeypatch):
    tree, w, texts = model
    whole = lm_scoring.Scorer(w, tree)(texts)
    monkeypatch.setattr(lm_scoring, "SLICE", 3)
    assert lm_scoring.Scorer(w, tree)(texts) == pytest.approx(whole, rel=1e-5)


def test_gradients_are_the_slopes_of_the_loss(model):
    tree, w, _ = model
    w = {k: x.astype(np.float64) for k, x in w.items()}
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, tree.rest + 1, (2, 3, 32))
    y[0, 20:] = tree.none
    _, d = lm_scoring.gradients(w, x, y, tree.none)
    for k in w:
        for at in np.argsort(-np.abs(d[k]).ravel())[:3]:
            ends = []
            for e in (1e-5, -1e-5):
                moved = {n: v.copy() for n, v in w.items()}
                moved[k].ravel()[at] += e
                ends.append(lm_scoring.gradients(moved, x, y, tree.none)[0])
            assert d[k].ravel()[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3), k


def test_training_learns_what_follows_what():
    """Ids that follow each other by rule: after training they are foretold, before only their frequencies are."""
    rng = np.random.default_rng(6)
    ids = (rng.integers(0, 50, (400, 1)) + 7 * np.arange(33)) % 50
    tree = lm_scoring.Tree(np.bincount(ids.ravel(), minlength=4000))
    windows = tree.local[ids].astype(np.int32)
    texts = list(ids[:20])
    before, after = (lm_scoring.Scorer(w, tree)(texts).mean() for w in (tree.weights(), lm_scoring.fit(tree.weights(), windows, tree.none, lm_scoring.RATE, 0)))
    assert before < -30 and after > 0.25 * before


def test_every_training_text_is_fitted_once(spark, monkeypatch):
    """Where the windows are many parts, the rounds take all of them between them, and no text is left out."""
    docs, path, taken, windows = docs_of(spark, real(spark)), queries.tokenizer_path(), [], lm_scoring.training_windows
    tree = lm_scoring.Tree(counts := lm_scoring.id_counts(lm_scoring.word_counts(docs), path))
    monkeypatch.setattr(lm_scoring, "LEAST_IDS", 1000, raising=False)
    monkeypatch.setattr(lm_scoring, "PART_IDS", 20_000)
    monkeypatch.setattr(lm_scoring, "training_windows", lambda *a: taken.append(windows(*a)) or taken[-1])
    fitted = lm_scoring.train(docs, tree, path, int(counts.sum()))
    rows = np.frombuffer(b"".join(r["window"] for r in taken[0].collect()), np.int16).reshape(-1, lm_scoring.CONTEXT + 1)
    assert (rows[:, 1:] >= 0).sum() == counts.sum() and counts.sum() > 2 * lm_scoring.PART_IDS
    assert all(np.isfinite(x).all() for x in fitted.values())


def test_training_and_scores_read_what_was_encoded_once(spark, monkeypatch):
    """No text is encoded for training and again for its score; windows of encoded texts are those of the texts, many to a row."""
    docs, path, calls, encoded, train = docs_of(spark, real(spark) + ODD), queries.tokenizer_path(), [], lm_scoring.encoded, lm_scoring.train
    monkeypatch.setattr(lm_scoring, "encoded", lambda *a: calls.append("encoded") or encoded(*a))
    monkeypatch.setattr(lm_scoring, "train", lambda d, *a: calls.append("line" in d.columns and "text" not in d.columns) or train(d, *a))
    lm_scoring.scores(docs, path)
    assert calls == ["encoded", True]
    tree = lm_scoring.Tree(lm_scoring.id_counts(lm_scoring.word_counts(docs), path))
    found = [sorted(map(tuple, lm_scoring.training_windows(d, tree, path).collect())) for d in (docs, encoded(docs, tree, path, {}))]
    assert found[0] == found[1] and len(found[0]) < sum(len(r[1]) for r in found[0]) / (2 * (lm_scoring.CONTEXT + 1))


def test_model_beats_its_unigram_start_on_held_out_texts(spark):
    found = queries.op12_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]
