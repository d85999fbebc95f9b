"""The training-data operators against brute force on small tables."""

import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import additive_ann, exact_topk, grammar_files, language_id, packing, passages, pieces, queries, simhash, tokens, toxicity, url_filter
from tidemill.llm.common import crc_fold

WORD = queries.vocabulary(queries.WORD_BPE)
PIECE = queries.vocabulary(queries.PIECE_BPE)
ODD = ["", None, " ", "a", "<|endoftext|> it's I'LL <b>", "Straße ²x² 漢字 a\u0085b İΑΣ", "word " * 3000, "\n\n x\ty"]


def words(seed, n, size=400):
    r = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i % 7}" for i in range(size)]
    return " ".join(r.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "a", "y"), (None, "no id", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def full_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD).encode(text or "", add_special_tokens=False).ids


# 1 and 8


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 16)).astype(np.float32).tolist()
    rows = [(i, v[i]) for i in range(400)] + [(400, v[0]), (401, v[0]), (402, None), (403, [0.0] * 16), (404, [float("nan")] * 16), (405, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(vectors, score, keep):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in vectors.collect() if r["embedding"] and np.isfinite(r["embedding"]).all() and keep(r["embedding"])]
    out = {}
    for q, a in rows:
        if q % 100 == 0:
            best = sorted((score(a, b), i) for i, b in rows if i != q)[:10]
            out[q] = [(i, s) for s, i in best]
    return out


def test_exact_topk(vectors):
    w = lambda a: np.floor(1024 * a).astype(np.int64)
    want = brute(vectors, lambda a, b: -int(w(a) @ w(b)), lambda v: True)
    got = exact_topk.search(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding").toPandas().sort_values(["query_id", "rank"])
    for q, rows in want.items():
        mine = got[got["query_id"] == q]
        assert list(zip(mine["vec_id"], -mine["score"])) == rows


def test_ann_recall_and_ties(spark, vectors):
    want = brute(vectors, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), lambda v: any(v))
    got = additive_ann.search(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", shortlist=100).toPandas()
    hits = sum(len({i for i, _ in rows} & set(got[got["query_id"] == q]["vec_id"])) for q, rows in want.items())
    assert hits >= 0.9 * 10 * len(want)
    first = got[got["query_id"] == 0].sort_values("rank")
    assert first["vec_id"].tolist()[:2] == [400, 401] and first["score"].tolist()[:2] == [0.0, 0.0]
    assert additive_ann.search(vectors.limit(0), vectors.limit(0), "vec_id", "embedding").count() == 0


def odd_vectors(spark):
    """Repeated ids, dimensions, nulls inside, huge components, clashing columns."""
    rows = [(0, [1.0, 2.0, 3e6]), (0, [1.0, 2.0, 3e6]), (0, [9.0, 0.0, 1.0]), (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 4.0]), (2, [5.0, 5.0, 5.0]), (3, [1.0, None, 2.0]), (4, [1.0, 2.0]), (100, [2.0, 2.0]), (5, None), (None, [1.0, 2.0, 3.0])]
    return spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<double>, vec_key int, score int")


def test_exact_topk_of_repeated_ids(spark):
    df = odd_vectors(spark)
    out = exact_topk.search(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding").collect()
    w = lambda v: [int(np.floor(1024 * x)) for x in v]
    rows = [(i, w(v)) for i, v in [(0, [1.0, 2.0, 3e6]), (0, [1.0, 2.0, 3e6]), (0, [9.0, 0.0, 1.0]), (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 4.0]), (2, [5.0, 5.0, 5.0]), (4, [1.0, 2.0]), (100, [2.0, 2.0])]]
    want = []
    for i, v in [rows[0], rows[2], rows[7]]:
        best = sorted((-sum(a * b for a, b in zip(v, u)), j) for j, u in rows if j != i)
        want += [(i, n, j, -s) for n, (s, j) in enumerate(best[:10], 1)]
    assert sorted(tuple(r) for r in out) == sorted(want)
    assert max(r["score"] for r in out) > 2**42
    assert exact_topk.search(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0


def test_ann_of_repeated_ids_and_dimensions(spark):
    df = odd_vectors(spark)
    out = sorted(tuple(r) for r in additive_ann.search(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding").collect())
    rows = [(0, [1.0, 2.0, 3e6]), (0, [9.0, 0.0, 1.0]), (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 4.0]), (2, [5.0, 5.0, 5.0]), (4, [1.0, 2.0]), (100, [2.0, 2.0])]
    want = []
    for i, v in [rows[0], rows[1], rows[6]]:
        best = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, u)))), j) for j, u in rows if j != i and len(u) == len(v))
        want += [(i, n, j, s) for n, (s, j) in enumerate(best, 1)]
    assert [(a, b, c) for a, b, c, _ in out] == [(a, b, c) for a, b, c, _ in sorted(want)]
    assert [s for *_, s in out] == pytest.approx([s for *_, s in sorted(want)])


def test_query_tiles_give_the_same(spark, vectors, monkeypatch):
    from tidemill.llm import common

    every = vectors.where("vec_id % 7 = 0")
    want = sorted(tuple(r) for r in exact_topk.search(vectors, every, "vec_id", "embedding").collect())
    monkeypatch.setattr(common, "TILE", 16)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 8)
    assert sorted(tuple(r) for r in exact_topk.search(vectors, every, "vec_id", "embedding").collect()) == want


def test_ann_refit_is_least_squares_without_a_matrix_of_all_words():
    import tracemalloc

    rng = np.random.default_rng(3)
    x, books, codes = rng.normal(size=(400, 11)), rng.normal(size=(3, 16, 11)), rng.integers(0, 15, (400, 3))  # no row has word 15
    ones = np.zeros((400, 48))
    for i in range(3):
        ones[np.arange(400), codes[:, i] + 16 * i] = 1
    want = np.linalg.solve(ones.T @ ones + 0.1 * np.eye(48), ones.T @ x + 0.1 * books.reshape(48, 11)).reshape(books.shape)
    assert np.allclose(additive_ann.refit(x, codes, books, exact=1e-9, steps=200), want, atol=1e-5)
    tracemalloc.start()
    additive_ann.fit(rng.normal(size=(300, 8)))  # as many words as for 10,000 rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6


def test_ann_recall_where_the_shortlist_is_small(spark):
    """50,000 directions without any structure: 256 of them, half a per cent, are reranked."""
    n, d = 50_000, 64
    v = np.random.default_rng(11).normal(size=(n, d))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), d).cast(pa.list_(pa.float32()))}))
    out = additive_ann.search(df, df.where("vec_id % 500 = 0"), "vec_id", "embedding").toPandas()
    hits = 0
    for q in range(0, n, 500):
        away = ((v.astype(float) - v[q].astype(float)) ** 2).sum(1)
        away[q] = np.inf
        hits += len(set(np.argsort(away, kind="stable")[:10]) & set(out[out["query_id"] == q]["vec_id"]))
    assert hits >= 0.9 * 10 * 100


# 2


def test_url_rules(spark):
    urls = ["https://a.NET/x?y", "http://EXAMPLE.net/en/1", "http://b.example.net/fr/", "https://example.com/de/2#z", "https://notexample.com/de/2", "ftp://x.org/fr/a", "nourl", None, "http://net", "http://xnet/"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert [out[i]["rule"] for i in range(10)] == ["net/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None]
    assert [out[i]["verdict"] for i in (0, 1, 2, 3, 5)] == ["block", "allow", "block", "block", "allow"]
    assert (out[0]["host"], out[0]["path"], out[7]["host"], out[8]["path"]) == ("a.net", "/x", "", "")


def test_url_model_tells_apart(spark):
    r = random.Random(1)
    good = [f"https://site{r.randrange(50)}.org/fr/article-{r.randrange(999)}" for _ in range(300)]
    bad = [f"https://win{r.randrange(50)}.net/casino-{r.randrange(999)}" for _ in range(300)]
    rest = ["https://other.io/fr/article-12", "https://other.io/casino-77"]
    pages = spark.createDataFrame(list(enumerate(good + bad + rest)), "page_id long, url string")
    out = {x["page_id"]: x["verdict"] for x in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert (out[600], out[601]) == ("allow", "block")


def brute_witten_bell(urls):
    """log p of every symbol by dictionaries of strings."""
    from collections import Counter

    count, n = url_filter.ORDER, [Counter() for _ in range(url_filter.ORDER)]
    seqs = [[0] * (count - 1) + [b + 1 for b in u.encode()] + [0] for u in urls]
    for s in seqs:
        for i in range(count - 1, len(s)):
            for k in range(count):
                n[k][tuple(s[i - k : i + 1])] += 1

    def p(ctx, x):
        if ctx is None:
            return 1 / url_filter.A
        mine = {g: c for g, c in n[len(ctx)].items() if g[:-1] == ctx}
        lower = p(ctx[1:] if ctx else None, x)
        total, kinds = sum(mine.values()), len(mine)
        return (mine.get((*ctx, x), 0) + kinds * lower) / (total + kinds) if total else lower

    def score(u):
        s = [0] * (count - 1) + [b + 1 for b in u.encode()] + [0]
        return [np.log(p(tuple(s[i - count + 1 : i]), s[i])) for i in range(count - 1, len(s))]

    return score


def fitted(urls):
    gram, *_ = url_filter.grams_of(pa.array(urls))
    return url_filter.fit_witten_bell(*np.unique(gram, return_counts=True))


def test_url_ratio_against_brute_force():
    good, bad = ["http://a.org/fr/x", "http://b.org/fr/yé", "x"], ["http://c.net/zz", "http://d.net/q?1"]
    asked = [*good, *bad, "http://a.net/fr", "", None, "ünknown☃"]
    one, two = brute_witten_bell(good), brute_witten_bell(bad)
    want = [np.mean(one(u or "")) - np.mean(two(u or "")) for u in asked]
    assert url_filter.ratio_of(pa.array(asked, pa.string()), fitted(good), fitted(bad)) == pytest.approx(want)


def test_markov_probabilities_sum_to_one():
    m = fitted(["http://a.org/x", "http://a.com/y", "häh"])
    for ctx in list(m.contexts[-1][:20]) + [np.uint64(7 << 9 | 3)]:
        p = np.exp(m.log_prob((ctx << np.uint64(url_filter.BITS)) | np.arange(url_filter.A, dtype=np.uint64))).sum()
        assert p == pytest.approx(1.0)


def test_url_verdicts_are_the_models(spark):
    """Verdicts of URLs without a rule follow the brute ratio and one threshold."""
    r = random.Random(4)
    rows = [(i, f"https://s{r.randrange(9)}.org/fr/p{r.randrange(99)}" if i % 2 else f"https://w{r.randrange(9)}.net/c{r.randrange(99)}") for i in range(60)]
    rows += [(100 + i, f"https://z{i}.io/{'fr/p' if i % 2 else 'c'}{i}") for i in range(20)] + [(200, None), (200, "x" * 20_000), (201, "no scheme")]
    pages = spark.createDataFrame([(*x, "c", 0.0) for x in rows], "page_id long, url string, rule string, score double")
    out = url_filter.judge(pages, queries.URL_RULES).collect()
    assert len(out) == len(rows)
    taught = [(u, i % 2) for i, u in rows[:60] if zlib.crc32(str(i).encode()) % 5]
    one, two = (fitted([u for u, k in taught if k == g]) for g in (1, 0))
    by_id = {r["page_id"]: r for r in out if r["page_id"] < 200}
    want = url_filter.ratio_of(pa.array([u for i, u in rows[:80]]), one, two)
    assert [by_id[i]["score"] for i, _ in rows[:80]] == pytest.approx(want.tolist())
    free = [r for r in out if r["rule"] is None]
    assert min([r["score"] for r in free if r["verdict"] == "allow"], default=9) >= max([r["score"] for r in free if r["verdict"] == "block"], default=-9)
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0


# 3 and 6


def packed(plan, hist, capacity):
    """Number of sequences, after checking that the plan holds exactly the pieces."""
    done = np.zeros(len(hist), dtype=int)
    for config, times in plan:
        assert times > 0 and sum(l * a for l, a in config) <= capacity
        for l, a in config:
            done[l] += a * times
    assert (done == hist).all()
    return sum(times for _, times in plan)


def test_plan_packs_exactly():
    r = np.random.default_rng(5)
    for n in (50, 3000):
        hist = np.bincount(r.integers(1, 101, n), minlength=101)
        total = packed(packing.plan(hist, 100), hist, 100)
        assert total <= 1.05 * -(-(hist * np.arange(101)).sum() // 100) + 1


def test_program_beats_best_fit_where_that_is_far_off():
    hist = np.zeros(101, dtype=int)
    hist[[51, 27, 26, 23]] = [60, 60, 60, 120]
    amounts, bound = packing.solve_lp(hist, 100)
    assert bound == pytest.approx(90) and sum(amounts.values()) == pytest.approx(90)
    assert packed(packing.plan(hist, 100), hist, 100) == 90 and sum(packing.best_fit(hist, 100).values()) == 110


@pytest.mark.parametrize("low,high,n,gap", [(1, 2048, 20_000, 1.01), (300, 1000, 5000, 1.03), (700, 1400, 30_000, 1.02), (900, 1100, 300, 1.1)])
def test_program_covers_and_its_bound_holds(low, high, n, gap):
    hist = np.bincount(np.random.default_rng(low).integers(low, high, n), minlength=2049)
    amounts, bound = packing.solve_lp(hist, 2048)
    cover = np.zeros(2049)
    for config, x in amounts.items():
        assert x > 0 and sum(l * a for l, a in config) <= 2048
        for l, a in config:
            cover[l] += a * x
    assert (cover >= hist - 1e-6).all()
    total = packed(packing.plan(hist, 2048), hist, 2048)
    assert (hist * np.arange(2049)).sum() / 2048 <= bound + 1e-6 and bound <= sum(amounts.values()) + 1e-6
    assert total >= bound - 1e-6 and total <= gap * bound + 1


def fewest(pieces, capacity):
    """Exhaustive: the least number of sequences."""
    best = len(pieces)

    def put(i, spaces):
        nonlocal best
        if len(spaces) >= best and i < len(pieces):
            return
        if i == len(pieces):
            best = min(best, len(spaces))
            return
        for j in {s: j for j, s in enumerate(spaces) if s >= pieces[i]}.values():
            put(i + 1, [*spaces[:j], spaces[j] - pieces[i], *spaces[j + 1 :]])
        put(i + 1, [*spaces, capacity - pieces[i]])

    put(0, [])
    return best


def test_plan_against_exhaustive_packing():
    r = random.Random(8)
    off = 0
    for _ in range(40):
        pieces = sorted((r.randrange(2, 14) for _ in range(r.randrange(4, 10))), reverse=True)
        hist = np.bincount(pieces, minlength=21)
        total, best = packed(packing.plan(hist, 20), hist, 20), fewest(pieces, 20)
        assert best >= packing.solve_lp(hist, 20)[1] - 1e-9
        off += total - best
        assert total <= best + 1
    assert off <= 4


def check_packed(rows, docs, capacity):
    for doc, piece, start, length, crc, *_ in rows:
        pass
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for i, t in docs:
        ids = [*full_ids(t), 0]
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], dtype="<u4")
            want.append((i, p, a, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)


def test_packing(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_packed(packing.pack_documents(odd, WORD, 128).collect(), docs, 128)
    assert packing.pack_documents(empty(spark), WORD).count() == 0


def test_token_files(spark, odd):
    shards = grammar_files.write_token_files(odd, WORD, shard_ids=500)
    out = grammar_files.read_token_files(shards).toPandas()
    docs = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: -1 if x[0] is None else x[0])
    want = sorted((len(full_ids(t)) + 1, zlib.crc32(np.array([*full_ids(t), 1], dtype="<u4").tobytes())) for _, t in docs)
    assert sorted(zip(out["n_tokens"], out["ids_crc32"])) == want
    out = out.sort_values("start")
    assert (out["start"] == out["n_tokens"].cumsum() - out["n_tokens"]).all()
    assert out["doc_id"].fillna(-1).is_monotonic_increasing
    assert grammar_files.read_token_files(grammar_files.write_token_files(empty(spark), WORD)).count() == 0


def test_fold_of_equal_lengths_is_the_fold_with_a_heap_in_less_memory():
    m, r = pieces.model(PIECE), random.Random(5)
    signs = "aaabehinorst" * 4 + "ABzq,.'-09éüñß▁" + "漢ไ☃\U0001f600\x01"
    some = ["", "▁", "☃", "aaaaaaaaaaaaaaaa", *("".join(r.choice(signs) for _ in range(r.randrange(1, 60))) for _ in range(3_000))]
    some += ["▁" + "".join(r.choice(["the", "ing", "er", "an", "qu", "é"]) for _ in range(r.randrange(1, 9))) for _ in range(2_000)]
    assert m.fold(some) == [m.fold_long(w) for w in some]
    assert m.fold([]) == [] and pieces.PieceModel.fold(m, ["▁a"]) == [m.fold_long("▁a")]
    rows = m.rows(np.array([[m._key(p) for p, _, _ in m.table]], dtype=np.uint64))[0]
    assert m.ids[rows].tolist() == [i for _, _, i in m.table]
    many = ["▁" + "".join(r.choice("aehinorst") for _ in range(15)) for _ in range(20_000)]
    tracemalloc.start()
    m.fold(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # before: scores and ids of all spans of all words, beside each other


class Counted:
    """A tokenizers model that counts the words it is asked for."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, word):
        self.calls += 1
        return self.model.tokenize(word)


def test_words_are_tokenized_once_a_group_and_as_the_library_does(monkeypatch):
    texts = ["", None, "  ", "Hello, hello HELLO! hello's it's can't 'S 're", "<|startoftext|>a<|endoftext|> a<b", "é É ÀÉ÷×ß ﬁ Σας İ e\u0301 a \u0301b"]
    texts += ["a\xa0b\x1cc\x85d \x00 \x7f", "漢字かな 12 1234 ½² ٣٤", "\tx\n\ny\r\n\x0b\x0cz ", "... --- !!'ll 'd've", "no_break 5'9 O'Re o're", "☃☃ \U0001f600"]
    full = tokens.tokenizer(WORD).full
    right = [full.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]
    for cache, group in ((0, 1), (3, 1 << 20), (1000, 1)):
        monkeypatch.setattr(tokens, "CACHE", cache)
        monkeypatch.setattr(tokens, "GROUP", group)
        monkeypatch.setitem(tokens._LOADED, WORD, tokens.WordTokenizer(WORD))
        batches = [pa.record_batch({"n": pa.array(range(lo, min(lo + 5, len(texts)))), "text": pa.array(texts[lo : lo + 5], pa.string())}) for lo in range(0, len(texts), 5)]
        out = [ids[a:b].tolist() for _, ids, at in tokens.encode_with_end(WORD, [*batches, batches[0].slice(0, 0), batches[0].slice(2)], 7) for a, b in zip(at, at[1:])]
        assert out == right + right[2:5]
    monkeypatch.setattr(tokens, "CACHE", 0)  # before, a word that was not remembered was tokenized wherever it stood
    monkeypatch.setattr(tokens, "GROUP", 1 << 20)
    monkeypatch.setitem(tokens._LOADED, WORD, tokens.WordTokenizer(WORD))
    tokens._LOADED[WORD].model = counted = Counted(tokens._LOADED[WORD].model)
    batch = pa.record_batch({"text": ["one, two; One two. " * 50] * 20})
    sizes = [len(ids) for _, ids, _ in tokens.encode_with_end(WORD, [batch] * 5, 7)]
    assert sizes == [20 * (50 * 7 + 1)] * 5 and counted.calls == 5  # one two , ; .


def test_rules_and_expansion_lengths_at_both_symbol_widths():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 60_000), 49_000).astype(np.int32)
    ids[5_000:7_000] = 4  # runs of overlapping matches
    offsets = np.concatenate([[0], np.sort(rng.choice(np.arange(1, len(ids)), 400, replace=False)), [len(ids)]])
    for base in (49_408, 70_000):
        shard = grammar_files.Shard(grammar_files.write_image(ids, offsets, np.arange(401), np.zeros(401, dtype=bool), base))
        assert len(shard.left) and len(shard.symbols) < 0.9 * len(ids)
        begin, size, _ = shard.expansions  # one gather a shard, where each round was expanded by itself before
        assert (size[base:] == shard.sizes).all() and (begin[:base] == np.arange(base)).all()
        assert (shard.expand(shard.symbols) == ids).all()
        assert all((shard.document(n) == ids[offsets[n] : offsets[n + 1]]).all() for n in range(401))


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(2)
    lens = r.integers(1, 90, 200)
    ids = np.repeat(r.integers(2, 40, lens.sum() // 2 + 1), 2)[: lens.sum()].astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(lens)])
    ids[offsets[1:] - 1] = 1
    shard = grammar_files.Shard(grammar_files.write_image(ids, offsets, np.arange(200), np.zeros(200, dtype=bool), 49408))
    assert len(shard.left) and len(shard.symbols) < len(ids)
    assert (shard.expand(shard.symbols) == ids).all()
    assert (shard.document(17) == ids[offsets[17] : offsets[18]]).all()
    for a, b in ((0, 5), (100, 1234), (len(ids) - 3, len(ids)), (7, 7)):
        assert (shard.ids(a, b) == ids[a:b]).all()


# 4


def zipf(r, n, size=20000):
    return [f"v{int(size ** r.random())}" for _ in range(n)]


def test_passages_with_words_changed_at_random_are_aligned(spark):
    r, rows = random.Random(3), []
    for i in range(100):
        passage = zipf(r, 50)
        changed = list(passage)
        for at in r.sample(range(50), 7):
            changed[at] = f"z{i}q{at}"
        rows += [(k + i, " ".join(zipf(r, 60) + p + zipf(r, 60))) for k, p in ((0, passage), (1000, changed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert passages.pieces(df).where("doc_id = source_id + 1000 and t1 - t0 >= 35").select("doc_id").distinct().count() >= 98


def test_passages_of_lines_known_from_elsewhere(spark):
    r = random.Random(4)
    lines = [zipf(r, r.choice((10, 11))) for _ in range(400)]
    rows = [(i, " ".join(sum((r.choice(lines) for _ in range(12)), []))) for i in range(600)]
    for i in range(100):
        passage = sum((r.choice(lines) for _ in range(6)), [])[:50]
        rows += [(k + i, " ".join(zipf(r, 30) + passage + zipf(r, 30))) for k in (10_000, 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert passages.repeated_passages(df).where("doc_id >= 20000 and start <= 33 and end >= 77").select("doc_id").distinct().count() == 100


def test_passages(spark):
    shared = words(1, 70)
    fuzzy = shared.split()
    fuzzy[30] = "changed"
    docs = [(1, words(2, 100) + " " + shared + " " + words(3, 40)), (2, words(4, 60) + " " + shared.upper()), (3, " ".join(fuzzy) + " " + words(5, 80)), (4, words(6, 200)), (5, None), (6, ""), (None, shared), (7, words(7, 40) + " " + " ".join(shared.split()[:30])), (8, words(6, 200))]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in docs], "doc_id long, text string, n_chars long, start string")
    found = {(r["doc_id"], r["start"], r["end"]): (r["source_id"], r["similarity"]) for r in passages.repeated_passages(df).collect()}
    assert set(found) == {(2, 60, 130), (3, 0, 70), (8, 0, 200)}
    assert found[(2, 60, 130)] == (1, 1.0) and found[(3, 0, 70)][1] == pytest.approx(69 / 70)
    cut = {r["doc_id"]: r for r in passages.cut_passages(df, passages.repeated_passages(df)).collect()}
    assert 8 not in cut and cut[2]["text"].split() == words(4, 60).split() and cut[2]["n_chars"] == len(cut[2]["text"])
    assert cut[1]["text"] == docs[0][1] and cut[4]["text"] == docs[3][1] and cut[5]["text"] is None and cut[None]["text"] == shared
    assert passages.repeated_passages(empty(spark)).count() == 0


def test_passages_of_repeated_ids_and_clashing_names(spark):
    """An id on unlike texts: each is a document of its own; rows alike are one."""
    shared = words(1, 70)
    rows = [(1, words(2, 100) + " " + shared), (1, words(3, 90)), (5, words(4, 30) + " " + shared), (5, shared + " " + words(6, 20)), (5, words(7, 60)), (5, words(7, 60)), (None, shared), (9, None)]
    df = spark.createDataFrame([(*r, 0, "x", None) for r in rows], "doc_id long, text string, _row_no int, _spans string, spans string")
    found = {(r["doc_id"], r["start"], r["end"], r["source_id"]) for r in passages.repeated_passages(df).collect()}
    assert found == {(5, 30, 100, 1), (5, 0, 70, 1)}
    out = passages.cut_passages(df, passages.repeated_passages(df))
    assert out.columns == df.columns and out.count() == len(rows)
    texts = sorted((r["text"] for r in out.where("doc_id = 5").collect()), key=len)
    assert sorted(map(str.split, texts)) == sorted([words(4, 30).split(), words(6, 20).split(), words(7, 60).split(), words(7, 60).split()])
    assert out.where("doc_id IS NULL").first()["text"] == shared


def test_passages_of_a_very_long_text(spark):
    long = " ".join(zipf(random.Random(5), 60_000))
    part = long.split()[30_000:30_200]
    df = spark.createDataFrame([(1, long), (2, " ".join(zipf(random.Random(6), 40) + part)), (3, long)], "doc_id long, text string")
    found = {(r["doc_id"], r["start"], r["end"]) for r in passages.repeated_passages(df).collect()}
    assert found == {(2, 40, 240), (3, 0, 60_000)}


def test_exact_passage_known_only_in_parts(spark):
    """All seeds of the passage stand in other documents, none of which has 12 of
    its words: found, since every word is known."""
    r = random.Random(9)
    passage = zipf(r, 60)
    rows = [(i, " ".join(zipf(r, 20) + passage[i : i + 9] + zipf(r, 20))) for i in range(0, 52, 3)]
    rows += [(100, " ".join(zipf(r, 20) + passage + zipf(r, 20)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    (row,) = passages.repeated_passages(df).collect()
    assert (row["doc_id"], row["start"], row["end"]) == (100, 20, 80)


def test_hot_seeds_are_linked_where_they_are_gathered(spark, monkeypatch):
    """A passage in every document, and passages in some: the same with and without."""
    r = random.Random(15)
    everywhere, some = zipf(r, 60), [zipf(r, 55) for _ in range(5)]
    rows = [(i, " ".join(zipf(r, 30) + everywhere + zipf(r, 20) + (some[i % 5] if i % 3 == 0 else []) + zipf(r, 10))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {}
    for hot in (4, 10**9):
        monkeypatch.setattr(passages, "HOT", hot)
        found[hot] = {(x["doc_id"], x["start"], x["end"]) for x in passages.repeated_passages(df).collect()}
    assert found[4] == found[10**9] and {i for i, s, e in found[4] if s <= 30 and e >= 90} == set(range(1, 80))


def test_long_gaps_are_aligned_by_words():
    r = random.Random(2)
    for _ in range(50):
        a, b = (np.array([r.randrange(6) for _ in range(r.randrange(1, 90))]) for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i, j] = best[i - 1, j - 1] + 1 if x == y else max(best[i - 1, j], best[i, j - 1])
        assert passages._lcs(a, b) == best[-1, -1]


def test_repeated_word_run(spark):
    df = spark.createDataFrame([(1, words(1, 30) + " the" * 100), (2, words(2, 30) + " the" * 80)], "doc_id long, text string")
    (row,) = passages.repeated_passages(df).collect()
    assert row["doc_id"] == 2 and row["end"] - row["start"] >= 70


def test_chain_is_best_collinear():
    r = random.Random(4)
    for _ in range(30):
        pts = sorted({(r.randrange(40), r.randrange(40)) for _ in range(12)})
        best = {}
        for i, (t, s) in enumerate(pts):
            gain = max((best[j] - passages.GAP_COST * (t - pts[j][0] + s - pts[j][1]) for j in range(i) if pts[j][0] < t and pts[j][1] < s), default=0.0)
            best[i] = passages.K + max(gain, 0.0)
        got = passages.chain(np.array([p[0] for p in pts]), np.array([p[1] for p in pts]))
        score = lambda c: sum(passages.K for _ in c) - sum(passages.GAP_COST * (b[0] - a[0] + b[1] - a[1]) for a, b in zip(c, c[1:]))
        long = [c for c in got if len(c) > 1]
        if long:
            assert max(map(score, long)) == pytest.approx(max(best.values()))


# 5


def test_pieces_equal_the_library(spark, odd):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    text = {(r["doc_id"], r["text"]) for r in odd.collect()}
    want = sorted((i if i is not None else -1, lib.encode(t or "")) for i, t in [(r["doc_id"], r["text"]) for r in odd.collect()])
    enc = pieces.encode_documents(odd, PIECE)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in enc.collect()) == want
    back = {(r["doc_id"], r["text"]) for r in pieces.decode_documents(enc, PIECE).collect()}
    assert back == {(i, t or "") for i, t in text}


def test_lattice_of_words_equals_the_library(spark):
    """Every distinct word of the documents, and odd ones, folded in Spark."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    ws = {pieces.SPACE + w for t in texts for w in (t or "").split(" ") if w and pieces.SPACE not in w}
    ws |= {pieces.SPACE + w for w in "theory Éauouon hello xyzzy Straße 漢字 supercalifragilistic aaaaaaaaaaaa ababababab \x01 ☃☃".split()}
    ws |= {pieces.SPACE + "theory" * 30, pieces.SPACE * 7 + "x", pieces.SPACE + "z" * 61, pieces.SPACE + "z" * 62}
    out = {r["word"]: r["ids"] for r in pieces.encode_words(spark.createDataFrame([(w,) for w in [*sorted(ws), "", None]], "word string"), PIECE).collect()}
    assert set(out) == ws
    bad = [w for w in ws if out[w] != lib.encode(w[1:] if w[1:2] != pieces.SPACE else w[1:].replace(pieces.SPACE, " "))]
    assert not bad


def test_piece_query(spark, data):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = queries.op5_piece_lattice(spark, data).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = lib.encode(texts[r["doc_id"]] or "")
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())


# 7 and 10


def test_toxicity(spark, odd):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        t = words(i, 40)
        if bad:
            w = t.split()
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["moronic", "scumbag", "lowlife"]))
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grammar = toxicity.fit(docs, spark.createDataFrame(labels + [(None, 1), (9, None)], "doc_id long, toxic int"))
    keep = [F.col("doc_id"), (crc_fold(F.col("doc_id")) == 2).alias("held_out")]
    out = toxicity.predict(docs, grammar, keep).toPandas()
    held = out[out["held_out"]]
    assert ((held["doc_id"] % 5 == 0) == (held["predicted"] == 1)).mean() > 0.97
    some = toxicity.predict(odd, grammar, [F.col("doc_id"), F.col("piece")]).toPandas()
    assert len(some) == 10 and some["score"].between(0, 1).all() and (some["predicted"] == 0).all()


def test_grammar_of_clauses():
    g = toxicity.Grammar({"moron": 1.0})
    read = lambda t: g.read(pa.array([t]))[0].tolist()
    plain, target, after, no, said = (read(t) for t in ("such moron talk", "you moron", "moron that you are", "you are not a moron", "he wrote moron again"))
    assert target[0] == after[0] > plain[0] > no[0] and no[3] > 0 and said[4] > 0
    assert read("kill you")[5] > 0 and read("you I will kill")[5] > 0 and read("kill time")[5] == 0 == read("never kill you")[5]
    assert read("better watch your back")[5] > 0 and read("watch your step, back")[5] == 0 and read("nothing here") == [0.0] * 6
    # a conjunction or a full stop ends what is quoted, denied or aimed
    assert read("he said it is fine but you moron")[0] == target[0] and read("he said. moron")[4] == 0
    assert read("not. a moron")[3] == 0 and read("you. moron")[0] == plain[0]


def test_composed_machines_do_what_one_after_the_other_does():
    t = toxicity
    stages = [t.phrase_machine([[t._PHRASED[w] for w in p.split()] for p in t.PHRASES], t._KIND_OF), t.NEGATED, t.AIMING, t.REPORTED]
    some = [t.OTHER, t.INSULT, t.THREAT, t.TARGET, t.NEGATION, t.REPORT, t.MODAL, *(t._PHRASED[w] for w in "watch your back".split())]
    sequences = list(itertools.product(some, repeat=4)) + [tuple(random.Random(i).choice(some) for _ in range(12)) for i in range(500)]
    for x in sequences:
        want = list(x)
        for m in stages:
            want = m.run(want)
        assert t.clause_machine().run(x) == want


def test_the_grammar_adds_to_the_lexicon(spark):
    """Insults aimed at someone are toxic here, denied and quoted ones are not."""
    r, rows, labels = random.Random(6), [], []
    for i in range(600):
        kind = i % 3
        aimed, denied, quoted = ["you {}", "they are {}", "{} that you are"], ["this is not {}", "never a {}"], ["as the critic wrote {}", "he claimed {}"]
        line = r.choice([aimed, denied, quoted][kind]).format(r.choice(["moronic", "scumbag", "lowlife"]))
        every = [x.format("table") for x in aimed + denied + quoted]  # so no other word tells anything
        rows.append((i, ". ".join([words(i, 20), line, *every, words(i + 1000, 20)])))
        labels.append((i, int(kind == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    right = {}
    for name, machine in (("grammar", None), ("lexicon", toxicity.LEXICON_ALONE)):
        g = toxicity.fit(docs, marks, odds=0.5, machine=machine)
        g.lexicon = {w: 1.0 for w in g.lexicon if w in ("moronic", "scumbag", "lowlife")}
        g = toxicity.fit_map(docs, marks, g)
        out = toxicity.predict(docs.where(crc_fold(F.col("doc_id")) == 2), g, [F.col("doc_id")]).toPandas()
        toxic, found = out["doc_id"] % 3 == 0, out["predicted"] == 1
        right[name] = (found[toxic].mean() + 1 - found[~toxic].mean()) / 2
    assert right["grammar"] > 0.95 and right["lexicon"] < 0.7


def test_toxicity_of_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    g = toxicity.fit(empty(spark), none)
    twice = spark.createDataFrame([(1, "you moron", "a"), (1, "you moron", "a"), (None, "x " * 50_000, None)], "doc_id long, text string, _text string")
    out = toxicity.predict(twice, g, [F.col("doc_id"), F.col("_text")])
    assert out.columns == ["doc_id", "_text", "score", "predicted"] and out.count() == 3
    assert toxicity.predict(empty(spark), g, [F.col("doc_id")]).count() == 0
    with pytest.raises(ValueError):
        toxicity.predict(twice, g, [F.col("text").alias("score")])
    g2 = toxicity.fit(twice, spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "doc_id long, toxic int"))
    assert np.isfinite(g2.weights).all()


def test_language(spark, odd):
    base = {"en": "the quick brown fox and the lazy dog that was there", "de": "der schnelle braune fuchs und der faule hund war dort", "fr": "le renard brun rapide et le chien paresseux était là"}
    r = random.Random(3)
    rows = []
    for i in range(300):
        lang = list(base)[i % 3]
        rows.append((i, " ".join(r.choice(base[lang].split()) for _ in range(20)), lang))
    docs = spark.createDataFrame([*rows, (999, "zz", None)], "doc_id long, text string, lang string")
    names, models = language_id.fit(docs.where(crc_fold(F.col("doc_id")) != 2))
    assert names == ["de", "en", "fr"]
    out = language_id.predict(docs.where("lang is not null"), names, models, [F.col("doc_id"), F.col("lang")]).toPandas()
    assert (out["lang"] == out["lang_pred"]).all() and not out["rejected"].any()
    some = {r["doc_id"]: r for r in language_id.predict(odd.where("doc_id < 3"), names, models, [F.col("doc_id"), F.col("piece")]).collect()}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in some.values())
    assert language_id.predict(odd, [], [], [F.col("doc_id")]).where("lang_pred <> 'und'").count() == 0
    far = spark.createDataFrame([(1, "xqzj wvkk zzqx jjxw qqvz xkcd " * 20), (1, rows[0][1]), (1, rows[0][1])], "doc_id long, text string")
    assert sorted(r["rejected"] for r in language_id.predict(far, names, models).collect()) == [False, False, True]
    assert language_id.fit(empty(spark))[0] == [] and language_id.predict(empty(spark), names, models).count() == 0


def brute_kneser_ney(words):
    """p of a symbol after a context, from dictionaries of tuples."""
    from collections import Counter

    n = language_id.ORDER
    top = Counter()
    for w in words:
        s = [0, *(ord(c) for c in w), 0]
        for i in range(1, len(s)):
            inner = s[max(1, i - n + 1) : i + 1] if i - n + 1 >= 1 else s[1 : i + 1]
            top[tuple([0] * (n - len(inner)) + inner)] += 1
    levels = {n: top}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discount = {}
    for k, c in levels.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(k, g):
        if k == 0:
            return 1e-5
        c, g = levels[k], g[-k:]
        mine = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        lower = p(k - 1, g)
        if not mine:
            return lower
        total = sum(mine.values())
        return max(c[g] - discount[k], 0) / total * (g in c) + discount[k] * len(mine) / total * lower

    return lambda g: p(n, g)


def test_kneser_ney_against_brute_force():
    words_ = ["banana", "bandana", "ananas", "cabana", "nab"]
    gram, of, count = language_id.grams_of(words_)
    key, n = np.unique(gram, return_counts=True)
    m = language_id.fit_kneser_ney(key, n)
    p = brute_kneser_ney(words_)
    asked = np.unique(np.concatenate([key, language_id.grams_of(["zebra", "bananas"])[0]]))
    split = lambda g: tuple(int(g) >> 16 * i & 0xFFFF for i in (3, 2, 1, 0))
    assert np.exp(m.log_prob(asked)) == pytest.approx([p(split(g)) for g in asked], rel=1e-5)
    assert count.tolist() == [len(w) for w in words_]


def test_kneser_ney_keeps_its_mass():
    g, _, _ = language_id.grams_of(["banana bandana ananas", "cabana"])
    key, n = np.unique(g, return_counts=True)
    m = language_id.fit_kneser_ney(key, n)
    letters = np.unique(key & np.uint64(0xFFFF))
    for ctx in np.unique(key >> np.uint64(16))[:10]:
        p = np.exp(m.log_prob((ctx << np.uint64(16)) | letters)).sum()
        assert 0.85 < p <= 1.0 + 1e-9  # the rest is for letters never seen


# 9


def test_simhash(spark):
    import xxhash

    docs = [(i, words(i, 80)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "one two"), (103, "One  TWO"), (104, docs[3][1] + " end"), (105, docs[3][1]), (None, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fp = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        fp[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    ids = [i for i in fp if i is not None]
    comp = {i: i for i in ids}
    for _ in range(5):
        for a in ids:
            for b in ids:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    want = {(i, fp[i], comp[i]) for i in ids} | {(None, fp[None], comp[5])}
    assert got == want
    kept = {r["doc_id"] for r in simhash.one_of_each(df, words=3).collect()}
    assert kept == {i for i in ids if comp[i] == i} | {None}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def near_copy_groups(texts, n=5, similarity=0.8):
    """The first of every group, by comparing all pairs."""
    sets = [{tuple(t.split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


def test_near_copies_of_one_text_all_go(spark):
    r = random.Random(5)
    base, texts = words(1, 200).split(), []
    for i in range(300):
        t = list(base)
        for at in r.sample(range(200), 3):
            t[at] = f"x{i}y{at}"
        texts.append(" ".join(t))
    texts = [" ".join(base), *texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.one_of_each(df).collect()} == near_copy_groups(texts) == {0}


def test_near_copies_scattered_appended_and_cut(spark):
    r = random.Random(6)
    texts = []
    for i in range(60):
        base = words(1000 + i, r.randrange(40, 400)).split()
        extra = words(2000 + i, max(1, len(base) * 15 // 100), 5000).split()
        scattered = [f"z{i}" if at % 90 == 11 else w for at, w in enumerate(base)]
        texts += [" ".join(x) for x in (base, base + extra, base[: len(base) * 85 // 100], scattered)]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.one_of_each(df).collect()} == near_copy_groups(texts)


def test_one_of_each_with_repeated_ids_and_clashing_names(spark):
    """Unlike texts of one id are documents; rows alike are one; copies go."""
    t = [words(i, 60) for i in range(4)]
    rows = [(1, t[0]), (1, t[1]), (2, t[2]), (2, t[2]), (3, t[0]), (4, None), (5, ""), (None, t[0]), (None, t[3])]
    df = spark.createDataFrame([(*r, 0, 0.5, "k") for r in rows], "doc_id long, text string, _row_no int, rep double, key string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, t[0]), (1, t[1]), (2, t[2]), (4, None), (None, t[0]), (None, t[3])], key=repr)


def test_prefixes_take_one_python_worker_a_task(spark):
    df = spark.createDataFrame([(i, f"some words of text {i} and more of them") for i in range(20)], "key long, text string")
    plan = simhash.prefixes(df, 5, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_gathered_seeds_are_not_held_twice():
    import tracemalloc
    from types import SimpleNamespace

    session = SimpleNamespace(conf=SimpleNamespace(set=lambda *_: None))
    docs = SimpleNamespace(sparkSession=session, select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    run, rng = passages.seeds(docs, 89), np.random.default_rng(5)
    batches = [pa.RecordBatch.from_pydict({"text": [" ".join(map(str, rng.integers(0, 50_000, 12_000))) for _ in range(10)], "doc_id": list(range(at, at + 10))}) for at in range(0, 200, 10)]
    tracemalloc.start()
    n = sum(len(x) // 5 for b in run(iter(batches)) for x in b.column("seed").to_pylist())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200 * (12_000 - passages.K + 1)
    assert most < 80 * passages.GATHER


def test_prefixes_keep_every_similar_pair(spark, monkeypatch):
    """Whatever is known to be frequent, similar texts share a first shingle."""
    r = random.Random(12)
    lines = [words(900 + i, 12) for i in range(6)]
    texts = [" ".join([words(i, r.randrange(20, 80)), *r.sample(lines, 3)]) for i in range(60)]
    texts += [t + " " + words(5000 + i, 4) for i, t in enumerate(texts[:20])]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    similar = {(a, b) for a in range(80) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    for one_of in (1, 4):
        monkeypatch.setattr(simhash, "ONE_OF", one_of)
        heads = {}
        for x in simhash.prefixes(df, 5, 0.8).collect():
            heads.setdefault(x["shingle"], set()).add(x["key"])
        assert len(similar) >= 15 and all(any({a, b} <= h for h in heads.values()) for a, b in similar)


def test_links_lose_nothing_in_large_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    r = random.Random(8)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for _ in range(60)} | {r.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = [(x["src"] % 2**64, x["dst"] % 2**64) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)

    def classes(pairs):
        c = {f: f for f in fps}
        for _ in range(70):
            for a, b in pairs:
                c[a] = c[b] = min(c[a], c[b])
        return c

    assert classes(edges) == classes([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])


# pipeline


def test_pipeline_runs(spark, data):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, data)
    assert rows.columns[:2] == ["doc_id", "piece"] and rows.count() > 0
    docs = empty(spark).withColumn("score", F.lit(1.0)).withColumn("doc", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name


def test_pipeline_stages_against_brute_force(spark):
    """Every stage on a fixture whose answer is known; null, empty, equal rows and
    clashing columns go through all of them."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    base = [" ".join(zipf(random.Random(i), 120)) for i in range(60)]
    passage = " ".join(zipf(random.Random(99), 80))
    rows, labels = [], []
    for i, t in enumerate(base):
        bad = i % 6 == 0
        rows.append((i, f"you scumbag lowlife moronic {t} you scumbag" if bad else t))
        labels.append((i, int(bad)))
    rows += [(100, base[1]), (101, base[2] + " tail words here"), (102, " ".join(zipf(random.Random(700), 60)) + " " + passage), (103, passage + " " + " ".join(zipf(random.Random(800), 60)))]
    rows += [(104, None), (105, ""), (106, "123 456"), (107, base[3]), (107, base[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, spans string")
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame([(i, 1, k) for i, k in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    clean = stage["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and ids(clean) == sorted(i for i, _ in rows if i % 6 or i >= 100)
    spoken = stage["language_id"](spark, clean, folder)
    assert ids(spoken) == [i for i in ids(clean) if i not in (104, 105, 106)]
    single = stage["simhash_near_dedup"](spark, spoken, folder)
    texts = {i: t for i, t in rows if i in ids(spoken)}
    order = sorted(texts)
    assert ids(single) == [order[k] for k in sorted(near_copy_groups([texts[i] for i in order]))] and 107 not in ids(single)
    cut = stage["substring_dedup"](spark, single, folder)
    assert ids(cut) == ids(single)
    by_id = {r["doc_id"]: r for r in cut.collect()}
    assert by_id[102]["text"] == texts[102] and by_id[103]["text"].split() == zipf(random.Random(800), 60) and by_id[103]["n_chars"] == len(by_id[103]["text"])
    assert all(by_id[i]["text"] == texts[i] for i in by_id if i != 103)
    packed_ = stage["best_fit_packing"](spark, cut, folder).collect()
    check_packed(packed_, [(i, r["text"]) for i, r in by_id.items()], 2048)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, spark, data):
    import oracle

    assert oracle.compare(oracle.connect(data), queries.QUERIES[name](spark, data), queries.ORACLE_SQL[name]) is None
