"""Operators against their SQL, libraries or brute force, and on odd tables."""

import collections
import math
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL, normal, same

import corpus_pipeline
import public_tokenizers
from lakesift.llm import line_dedup, lm, mixing, ngram_join, pieces, quality, registry, token_counts, topk, toxicity, warc

ODD = [
    (1, None, "s", "x"), (2, "", "s", "x"), (3, "   \n\t ", None, "x"), (4, "one two three four five", "s", "x"),
    (4, "one two three four five", "s", "x"), (5, "word " * 3000, "t", "x"), (None, "no id here at all", None, None),
    (6, "A\x0bB C  ‐ é\r\nsame line here\nsame line here", "t", "x"), (7, "a" * 20000, "t", "x"),
]
SCHEMA = "doc_id long, text string, source string, n string"


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns carry names that operators use themselves.
    return spark.createDataFrame([(*r, "k") for r in ODD], SCHEMA + ", line string").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    same(registry.QUERIES[name](spark, SMALL), duck.sql(registry.ORACLE_SQL[name]))


def texts(frame):
    return {r.doc_id: r.text or "" for r in frame.collect()}


def test_token_counts_equal_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "<|endoftext|> a<|startoftext|>"), (-2, "ΑΣ ΣΑΣ é É ﬁ 12ab'S it's　x")], "doc_id long, text string")
    for frame in (docs, odd.select("doc_id", "text"), extra):
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame, public_tokenizers.path("word_bpe_49k.json")).collect())
        want = sorted((r.doc_id or 0, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in frame.collect())
        assert got == want


def test_pieces_equal_library_and_round_trip(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "  a   b" + " " * 40), (-2, "▁x ① \x00\t日本"), (-3, "<s>")], "doc_id long, text string")
    for frame in (docs, odd, extra):
        encoded = pieces.encode(frame, path).collect()
        want = sorted((r.doc_id or 0, library.encode(r.text or "")) for r in frame.collect())
        assert sorted((r.doc_id or 0, r.tokens) for r in encoded) == want
        assert all(r.round_trip for r in encoded)
    back = texts(pieces.decode(pieces.encode(docs, path), path))
    assert back == texts(docs)


def test_toxicity_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1"  # sf0.01 has few more than thirty toxic texts to learn from
    got = toxicity.query(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    rank = got.score.rank()
    n1 = int((got.toxic == 1).sum())
    area = (rank[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(got) - n1))
    assert area > 0.93 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_toxicity_odd_tables(spark, odd, none):
    held = lambda key: toxicity.fold(key, 4, 2)
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert toxicity.score(odd, labels, held).count() == len(ODD)
    assert toxicity.score(none, labels, held).count() == 0
    assert {r.score for r in toxicity.score(odd, labels.limit(0), held).collect()} == {0.0}


def brute_base(rows, held):
    word = re.compile("[^\x20\x09-\x0d]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [*word.findall((t or "").translate(low)), "</end>"]) for i, t in rows]
    counts = collections.Counter()
    for i, own in tokens:
        if i is not None and not held(i):
            counts.update(own)
    total = sum(counts.values())
    by = math.log10(total + len(counts) + 1)
    return sorted((i or 0, len(own), sum(counts[w] > 0 for w in own), total, round(sum(math.log10(counts[w] + 1) - by for w in own), 6)) for i, own in tokens)


def test_lm_base_and_gain(spark, odd, none):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    fold = lambda key: toxicity.fold(key, 7, 2)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for frame in (docs, odd.select("doc_id", "text")):
        got = lm.score(frame, fold).collect()
        rows = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
        want = brute_base([tuple(r) for r in frame.collect()], held)
        assert [r[:4] for r in rows] == [r[:4] for r in want]
        assert np.allclose([r[4] for r in rows], [r[4] for r in want])
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
        if frame is docs:
            assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert lm.score(none, fold).count() == 0


def test_lm_trains_on_every_token(spark):
    docs = spark.createDataFrame([(f"word{i} " * (1 + 7 * i),) for i in range(40)], "text string").repartition(2)
    words = lm.Vocabulary(np.array([lm.END], np.uint64), np.array([40]), 40, 1)
    shared = spark.sparkContext.broadcast((lm.gru.start(words.counts), words))
    rows = docs.mapInArrow(lm._trained(shared), lm.WEIGHTS).filter("part = 0").collect()
    assert sum(r.tokens for r in rows) == sum(1 + 7 * i + 1 for i in range(40))


def test_lm_weights_move_once_a_shard_however_many_partitions(spark, monkeypatch):
    """A session that deals by more partitions trains as many shards, with the same scores, and moves no more weights."""
    fold = lambda key: toxicity.fold(key, 7, 2)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    frame, kept = type(docs), type(docs).repartition
    moved, trained = [], lm._trained

    def counted(*args):
        run, seen = trained(*args), spark.sparkContext.accumulator(0)
        moved.append(seen)

        def out(batches):
            for batch in run(batches):
                seen.add(sum(p == 0 for p in batch.column(1).to_pylist()))
                yield batch

        return out

    monkeypatch.setattr(lm, "SHARD", 1 << 14)
    monkeypatch.setattr(lm, "_trained", counted)
    one = {r.doc_id: r.score for r in lm.score(docs, fold).collect()}
    first = [x.value for x in moved]
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: kept(self, max(31, n) if cols else n, *cols))
    moved.clear()
    many = {r.doc_id: r.score for r in lm.score(docs, fold).collect()}
    assert first == [x.value for x in moved] and 1 < max(first) < 31
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-4) for k in one)


def test_lm_scores_alike_however_the_table_is_partitioned(spark):
    fold = lambda key: toxicity.fold(key, 7, 2)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r.score for r in lm.score(docs.repartition(n), fold).collect()} for n in (1, 5))
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-4) for k in one)


def test_lm_segments_go_on():
    starts, lengths, warm = lm._segments(np.array([1, lm.SEGMENT, 2 * lm.SEGMENT + 5]))
    own = starts + warm
    assert own.tolist() == [0, 1, lm.SEGMENT + 1, 2 * lm.SEGMENT + 1, 3 * lm.SEGMENT + 1]
    assert (lengths - warm).tolist() == [1, lm.SEGMENT, lm.SEGMENT, lm.SEGMENT, 5]
    words = np.arange(1, 8)
    got = list(lm.gru.streams(words, np.array([0, 2]), np.array([4, 5]), 1, 0, np.array([0, 2])))
    inputs, fresh, y, at, use = (np.concatenate([w[k][:, 0] for w in got]) for k in range(5))
    # The longer row goes first: it follows word 2, reads 3 and 4 for the state, and counts from 5 on.
    assert inputs[:9].tolist() == [2, 3, 4, 5, 6, 0, 1, 2, 3] and y[:9].tolist() == [3, 4, 5, 6, 7, 1, 2, 3, 4]
    assert np.flatnonzero(fresh).tolist() == [0, 5] and np.flatnonzero(use).tolist() == [2, 3, 4, 5, 6, 7, 8]


def test_gru_text_by_hand():
    from lakesift.llm import gru

    counts = np.array([9.0, 5, 4, 3, 2, 2, 1, 1])
    w, limits, k = gru.start(counts), gru.class_limits(counts), gru.HIDDEN
    text, end = [3, 1, 7, 0, 2, *[5, 6, 4] * 9, 0], 0
    h, want, before = np.zeros(k), 0.0, end
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for word in text:
        x, r = w["x"][before].astype(float), h @ w["u"]
        z, g = (np.array([sigmoid(v) for v in (x + r)[a : a + k]]) for a in (0, k))
        h = (1 - z) * np.tanh(x[2 * k :] + g * r[2 * k :]) + z * h
        c = max(i for i in range(len(limits) - 1) if limits[i] <= word)
        kind, own = h @ w["wc"] + w["bc"], (h @ w["ww"] + w["bw"])[limits[c] : limits[c + 1]]
        want += kind[c] - math.log(np.exp(kind).sum()) + own[word - limits[c]] - math.log(np.exp(own).sum())
        before = word
    words = np.array([*text, 1, 0])
    got = gru.score_rows(w, limits, words, np.array([0, len(text)]), np.array([len(text), 2]), end, 4)
    assert math.isclose(got[0], want, rel_tol=1e-5)


def test_gru_optimiser_lasts_over_parts():
    from lakesift.llm import gru

    counts = np.array([9.0, 5, 4, 3, 2, 2, 1, 1])
    words = np.random.default_rng(3).integers(0, 8, 96)
    halves = [(np.arange(0, 96, 16)[i : i + 3], np.full(3, 16)) for i in (0, 3)]
    whole, parts, anew = (gru.Trainer(gru.start(counts), gru.class_limits(counts), 0, 0.01, 0.001, 96, n) for n in (3, 3, 3))
    whole.learn(words, np.arange(0, 96, 16), np.full(6, 16))
    for starts, lengths in halves:
        parts.learn(words, starts, lengths)
    assert whole.step == parts.step == 2 and whole.seen == parts.seen == 96
    anew.learn(words, *halves[0])
    first = anew.w
    anew = gru.Trainer(first, gru.class_limits(counts), 0, 0.01, 0.001, 96, 3)
    anew.learn(words, *halves[1])
    assert any(not np.allclose(parts.w[k], anew.w[k]) for k in parts.w)


def test_gru_probabilities_add_up():
    from lakesift.llm import gru

    counts = np.array([50.0, 20, 10, 5, 5, 2, 1, 1])
    w, limits = gru.start(counts), gru.class_limits(counts)
    state = np.random.default_rng(0).normal(size=(1, gru.HIDDEN)).astype(np.float32)
    p = np.exp(gru.log_probabilities(w, limits, np.repeat(state, 8, axis=0), np.arange(8)))
    assert abs(p.sum() - 1) < 1e-5


def test_gru_gradients():
    from lakesift.llm import gru

    random = np.random.default_rng(1)
    counts = np.array([9.0, 5, 4, 3, 2, 2, 1, 1])
    w, limits = {k: v.astype(np.float64) for k, v in gru.start(counts).items()}, gru.class_limits(counts)
    ids, y = random.integers(0, 8, (5, 3)), random.integers(0, 8, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[0], fresh[3, 1] = True, True
    use = np.ones((5, 3), bool)
    h = np.zeros((3, gru.HIDDEN))

    def loss(w):
        states, _ = gru.run(w, ids, fresh, h, keep=True)
        return -gru.log_probabilities(w, limits, states.reshape(-1, gru.HIDDEN), y.ravel()).mean()

    g, _ = gru.gradients(w, limits, ids, fresh, y, use, h)
    for k in w:
        at = np.unravel_index(random.integers(w[k].size), w[k].shape)
        big = {**w, k: w[k].copy()}
        big[k][at] += 1e-2
        small = {**w, k: w[k].copy()}
        small[k][at] -= 1e-2
        assert abs((loss(big) - loss(small)) / 2e-2 - g[k][at]) < 2e-3


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [3.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = lambda key: key % 50 == 0
    got = sorted(map(tuple, topk.search(frame, ask).select("query_id", "rank", "vec_id", "score").collect()))
    good = {i: [math.floor(256 * c) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    want = []
    for q in (0, 50):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]  # noqa: B905
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.search(frame.limit(0), ask).count() == 0


def test_top_k_prunes_and_is_exact():
    random = np.random.default_rng(2)
    x = np.concatenate([random.integers(-9, 9, (300, 8)) + 400 * random.integers(-1, 2, 8) for _ in range(6)]).astype(float)
    tree = topk.Tree.of(np.arange(len(x)), x)
    asks = topk.Tree.of(np.arange(0, len(x), 50), x[::50], topk.ASK_LEAF)
    best = topk.Best(asks.ids, 5)
    done = topk.walk(asks, tree, best)
    assert done < 0.7 * len(x) * len(asks.ids)
    for r, q in enumerate(asks.ids):
        s = (x @ x[q]).astype(int)
        assert list(best.found[r]) == sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:5]


def test_top_k_products_on_the_table():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x, ids = topk._matrix([np.array(v) for v in t.column("embedding").to_pylist()]), t.column("vec_id").to_numpy()
    tree, own = topk.Tree.of(ids, x), ids % 50 == 0
    asks = topk.Tree.of(ids[own], x[own], topk.ASK_LEAF)
    best = topk.Best(asks.ids, 5)
    assert topk.walk(asks, tree, best) <= 0.3 * len(x) * own.sum()
    for r, q in enumerate(asks.ids):
        s = (x @ asks.x[r]).astype(int)
        assert list(best.found[r]) == ids[sorted((i for i in range(len(x)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:5]].tolist()


def test_pieces_long_words_and_empty_table(spark, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    assert pieces.encode(none, path).count() == 0
    encoder = pieces.Encoder(pieces.load(path))
    for text in ("a" * 3000, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20000)), "".join(rng.choices(string.ascii_letters + string.digits, k=20000)), "é①\x00" * 50):
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_arc_header_line_of_any_length(spark):
    pages = spark.createDataFrame([(1, "http://a/" + "x" * 70000, "one"), (2, "u", "two")], "page_id long, url string, html string")
    assert {(r.page_id, r.payload_bytes, r.record_type) for r in warc.archive(pages).collect()} == {(1, 3, "response"), (2, 3, "response")}


def test_quality_carriage_returns(spark):
    text = "\r\n".join(f"Sentence number {w} has its own few words and ends here." for w in ("one", "two", "three", "four"))
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_removed == 0 and row.n_lost_words == 0


def test_mix_meets_targets(spark, odd, none):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert ((got._taken <= 3 * got._size) & (got._shards.map(len) * got._size == got._taken)).all()
    by = got.groupby("source").agg(taken=("_taken", "sum"), target=("_target", "first"), most=("_size", "max"))
    assert ((by.taken - by.target).abs() <= by.most / 2 + 1).all()
    assert abs(by.target.sum() - got._size.sum()) < 1
    assert mixing.mix(none).count() == 0
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r._taken == 0 for r in rows if not r._size)
    assert rows == mixing.mix(odd).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))


def test_line_dedup_odd(spark, odd, none):
    assert line_dedup.judge_lines(none).count() == 0
    got = {(r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.judge_lines(odd).collect()}
    assert (1, 0, 0) in got and (6, 3, 1) in got and (4, 1, 0) in got
    kept = line_dedup.drop_lines(odd).collect()
    assert set(odd.columns) == set(kept[0].__fields__)
    assert any(r.doc_id is None for r in kept)


def test_line_dedup_near_lines(spark):
    base = "the quick brown fox jumps over the lazy dog while the band plays on and on until the morning light comes back"
    docs = spark.createDataFrame([(1, base), (2, base.replace("lazy", "lazi")), (3, base.upper() + "\nanother line of text that is quite different from all"), (4, "x y z")], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.judge_lines(docs).collect()}
    assert got == {1: [], 2: [0], 3: [0], 4: []}


def changed(rng, alphabet, line, at):
    """The line with other characters at some places."""
    return "".join(rng.choice([c for c in alphabet if c != x]) if i in at else x for i, x in enumerate(line))


def test_line_dedup_lines_without_blanks(spark):
    rng = random.Random(1)
    han, b64 = [chr(0x4E00 + i) for i in range(3000)], string.ascii_letters + string.digits + "+/"
    pairs = []
    for _ in range(40):
        line = "".join(rng.choices(han, k=200))
        pairs.append((line, changed(rng, han, line, {0})))
        line = "data:image/png;base64," + "".join(rng.choices(b64, k=298))
        pairs.append((line, changed(rng, b64, line, {rng.randrange(22, 320), rng.randrange(22, 320)})))
    pairs += [("=" * 90, "=" * 300), ("-+" * 40, "-+" * 400)]
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.judge_lines(docs).collect() if r.removed == [1]} == set(range(len(pairs)))


def test_line_dedup_families_on_one_template(spark):
    rng = random.Random(2)
    letters = string.ascii_lowercase
    template, pairs = "".join(rng.choices(letters, k=160)), []
    for _ in range(300):  # similarity 0.76 or so across families, over 0.9 within one
        line = template + "".join(rng.choices(letters, k=24))
        pairs.append((line, line[:-1] + rng.choice([c for c in letters if c != line[-1]])))
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    assert {(r.doc_id, *r.removed) for r in line_dedup.judge_lines(docs).collect()} == {(i, 1) for i in range(len(pairs))}


def test_line_dedup_many_families_right_at_the_limit(spark):
    rng = random.Random(9)
    letters = string.ascii_lowercase
    template, pairs = "".join(rng.choices(letters, k=68)), []
    for _ in range(1000):  # 76 shingles, of which a letter touches 8: similarity 0.81 within a pair, 0.67 across
        line = template + "".join(rng.choices(letters, k=15))
        pairs.append((line, changed(rng, letters, line, {rng.randrange(8, 75)})))
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    got = {(r.doc_id, *r.removed) for r in line_dedup.judge_lines(docs).collect()}
    found = {i for i, *lines in got if lines == [1]}
    assert len(found) >= 990 and all(lines in ([], [1]) for _, *lines in got)


def test_line_dedup_pairs_of_one_template(spark):
    rng = random.Random(5)
    letters = string.ascii_lowercase
    template = "".join(rng.choices(letters, k=70))
    texts_ = []
    for _ in range(300):
        line = list(template)
        for i in rng.sample(range(70), 2):
            line[i] = rng.choice(letters)
        line += rng.choices(letters, k=40)
        texts_.append("".join(line) + "\n" + "".join([*line[:-1], rng.choice("0123456789")]))
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    lines = sorted({x for t in texts_ for x in t.split("\n")})
    sets = {x: {x[i : i + 8] for i in range(len(x) - 7)} for x in lines}
    root = {x: x for x in lines}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    want = sum(t.count("\n") + 1 for t in texts_) - len({top(x) for x in lines})
    got = sum(r.n_removed for r in line_dedup.judge_lines(docs).collect())
    assert 0.98 * want <= got <= want


def test_ngram_join_odd(spark, odd, none):
    assert ngram_join.link(none).count() == 0
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.link(odd).collect())
    assert got == [(0, 2, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (4, 2, 4), (5, 1, 5), (6, 7, 6), (7, 1, 7)]


def test_ngram_join_family_of_near_copies(spark):
    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(300)], []
    for i in range(300):
        own = list(base)
        for k in rng.sample(range(300), rng.choice([1, 2, 3, 4, 6])):
            own[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(297)} for _, t in rows]
    root = list(range(300))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(300):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: top(i) for i in range(300)}


def test_quality_odd(spark, odd, none):
    assert quality.judge(none.select("doc_id", "text")).count() == 0
    got = {r.doc_id: r for r in quality.judge(odd.select("doc_id", "text")).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and got[5].n_repeat_words == 3000
    assert set(quality.filter_documents(odd).columns) == set(odd.columns)


def test_warc_odd(spark):
    rows = [(1, "http://a b/", "same"), (2, None, "same"), (3, "", None), (4, "u", ""), (5, "u", "é" * 10), (5, "u", "é" * 10), (None, "u", "x\r\n\r\ny\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = normal([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages).collect()], ["a", "b", "c", "d"])
    want = [(1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 20, "response", None), (5, 20, "response", None), (None, 17, "response", None)]
    assert got == normal(want, ["a", "b", "c", "d"])
    assert warc.archive(pages.limit(0)).count() == 0


def test_arc_versions():
    one = b"filedesc://x.arc 0.0.0.0 20200101000000 text/plain 9\n1 0 me\nab\n\nhttp://a/ 1.2.3.4 20200101000000 text/html 5\nhello\n"
    assert [(r.version, r.url, r.payload) for r in warc.parse_arc(one)] == [(1, "http://a/", b"hello")]
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_arc(one[:-4]))


def test_pipeline_against_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    kept = stages["quality_rules"](spark, docs, SMALL).cache()
    want = c.sql(f"SELECT doc_id, clean_text FROM ({quality.oracle().replace('{more}', ', clean_text')}) WHERE kept")
    assert normal([(r.doc_id, r.text) for r in kept.collect()], ["a", "b"]) == normal(want.fetchall(), ["a", "b"])
    c.register("kept", kept.toPandas())
    lined = stages["line_dedup"](spark, kept, SMALL).cache()
    gone = set(c.sql(f"WITH {line_dedup.oracle('kept')} SELECT doc_id, pos FROM gone").fetchall())
    rest = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in texts(kept).items()}
    assert texts(lined) == {i: t for i, t in rest.items() if t.strip()}
    alone = stages["ngram_jaccard_join"](spark, lined, SMALL).cache()
    shingles = {}
    for i, t in texts(lined).items():
        w = re.findall("[^\x20\x09-\x0d]+", t.lower())
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    roots = {i: i for i in shingles}

    def top(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for a in shingles:
        for b in shingles:
            if a < b and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                x, y = sorted((top(a), top(b)))
                roots[y] = x
    assert set(texts(alone)) == {i for i in shingles if top(i) == i}
    c.register("alone", alone.toPandas())
    mixed = stages["mix_sources"](spark, alone, SMALL).cache()
    times = dict(c.sql(f"WITH {mixing.oracle('alone')} SELECT doc_id, times FROM mixed WHERE times > 0").fetchall())
    assert collections.Counter(r.doc_id for r in mixed.collect()) == times
    for a, b in ((docs, kept), (kept, lined), (lined, alone), (alone, mixed)):
        assert a.columns == b.columns
    final = corpus_pipeline.run(spark, SMALL)
    assert collections.Counter(r.doc_id for r in final.collect()) == times
    assert all(r.round_trip for r in final.collect())


def test_ngram_join_sizes_on_either_side_of_a_step(spark):
    """A pair whose sizes ask for different numbers of shared index tokens: 71 shingles, 61 of them the other's, which is just enough."""
    rows = []
    for k in range(40):
        long = [f"w{k}x{i}" for i in range(74)]
        rows += [(2 * k, " ".join(long[:64])), (2 * k + 1, " ".join(long))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (71 if i % 2 else 61, i - i % 2) for i in range(80)}


def test_ngram_join_strays_form_few_pairs(spark):
    """Documents of one family that are no near copies: tokens that all of them hold form no pairs."""
    from lakesift.llm.common import Scratch

    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(120):  # each lacks other words, too many for a link
        own = list(base)
        for j in range(6):
            own[(k * 7 + j * 25) % 150] = f"v{k}x{j}"
        rows.append((k, " ".join(own)))
    met, write = [], Scratch.write

    def spied(self, df, name, by=None):
        out = write(self, df, name, by)
        if name in ("met", "opened"):
            met.append(out.count())
        return out

    Scratch.write = spied
    try:
        got = {r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        Scratch.write = write
    assert len(got) > 60 and len(met) == 1 and met[0] < 120 * 119 / 2 / 3


def test_line_dedup_components_meet_where_a_pair_can(spark):
    """Lines alone that share a late shingle only don't meet; those that share an early one do."""
    n = 40
    rows = [(1, i, i, 100, 19) for i in range(n)] + [(2, i, i, 100, 5) for i in (0, 1)]
    early = spark.createDataFrame(rows, "token long, line_id long, root long, size int, place int")
    got = [(r.token, r.a_root, r.b_root) for r in line_dedup._meet(early).collect()]
    assert got == [(2, 1, 0)]
    assert [tuple(r) for r in line_dedup._apart(early).collect()] == [(1, 0)]


def test_line_dedup_pairs_form_once(spark):
    """A line alone and a family's line that share several early shingles form one pair, at the first of them."""
    rows = [(t, i, i if i == 99 else 0, 100, place) for i in (*range(5), 99) for t, place in ((1, 2), (2, 3), (3, 5 if i else 7))]
    early = spark.createDataFrame(rows, "token long, line_id long, root long, size int, place int")
    got = sorted(tuple(r) for r in line_dedup._apart(early).collect())
    assert got == [(99, i) for i in range(5)]


def test_line_dedup_signs_by_few_shingles(spark):
    """A line of middle length signs by about half of its shingles, where it did by all; a short one by all. One kind of each has number 0."""
    rng = random.Random(11)
    lines = ["".join(rng.choices(string.ascii_lowercase, k=k)) for k in (40, 130, 400) for _ in range(50)]
    rows = line_dedup._kinds(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    signed = collections.Counter()
    for r in rows:
        signed[len(r.line)] += len(r._h)
    assert signed[40] == 50 * 33 and signed[130] < 50 * 123 and signed[400] < 50 * 393 * 0.4
    assert sorted(r.line for r in rows if r.kind == 0) == sorted(lines)


def test_line_dedup_middle_lengths_right_at_the_limit(spark):
    """Pairs of lines of all lengths where the kind of signature changes, 0.80 to 0.83 similar: nearly all are found."""
    rng = random.Random(13)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 9))) for _ in range(3000)]
    pairs = []
    while len(pairs) < 1000:
        n = rng.randrange(76, 260)
        line = " ".join(rng.choices(words, k=80))[:n].strip()
        other = changed(rng, string.ascii_lowercase, line, {rng.randrange(8, len(line) - 8) for _ in range(len(line) // 72)})
        a, b = ({x[i : i + 8] for i in range(len(x) - 7)} for x in (line, other))
        if 80 * len(a | b) <= 100 * len(a & b) <= 83 * len(a | b):
            pairs.append((line, other))
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    found = sum(r.n_removed for r in line_dedup.judge_lines(docs).collect())
    assert 990 <= found <= 1000


def test_line_dedup_maps_tell_odd_counts(spark):
    """The map has a bit for each shingle that falls there alone; equal lines but for one character differ in few bits."""
    line = "the quick brown fox jumps over the lazy dog while the band plays on and on"
    rows = [(0, line), (1, line.replace("z", "s")), (2, "ab")]
    got = {r.line_id: r for r in line_dedup._prints(spark.createDataFrame(rows, "line_id long, line string")).collect()}
    bits = {i: [bin(r[f"bits{w}"] & (2**64 - 1)).count("1") for w in range(line_dedup.WORDS)] for i, r in got.items()}
    n = len({line[i : i + 8] for i in range(len(line) - 7)})
    assert got[0]["size"] == got[1]["size"] == n and got[2]["size"] == 1
    assert sum(bits[2]) == 1 and n - 12 <= sum(bits[0]) <= n and sum(b > 0 for b in bits[0]) > line_dedup.WORDS / 2
    apart = sum(bin((got[0][f"bits{w}"] ^ got[1][f"bits{w}"]) & (2**64 - 1)).count("1") for w in range(line_dedup.WORDS))
    assert 10 <= apart <= 16


def test_line_dedup_normal_form_of_plain_and_odd_space(spark):
    """Texts with single blanks don't meet the pattern of white space; each kind of other white space still does."""
    odd = ["A b\nC", "a  b", "a\tb", "a\x0bb", "a\x0cb", "a\r\nb", "a \tb", "\t a", ""]
    rows = spark.createDataFrame(list(enumerate([*odd, None])), "i int, t string").select("i", line_dedup.normal(F.col("t")).alias("n"))
    assert [r.n for r in rows.orderBy("i").collect()] == ["a b\nc", "a b", "a b", "a b", "a b", "a \nb", "a b", " a", "", None]


def test_lm_hashes_long_batches_in_parts():
    """Helper arrays of the hashing are bounded, whatever the batch holds; the hashes are the same."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["some words of a text, Over and over " * 40, None, "", "a"] * 1000)
    raw, offsets = lm.text_buffers(texts)
    hashes, lengths = lm._token_hashes(raw, offsets)
    one = [lm._token_hashes(*lm.text_buffers(texts.slice(i, 1))) for i in range(4)]
    assert lengths.tolist() == [len(h) for h, _ in one] * 1000 and (hashes == np.concatenate([h for h, _ in one] * 1000)).all()
    assert lm._token_hashes(raw[:0], offsets[:1])[1].tolist() == []
    tracemalloc.start()
    lm._token_hashes(raw, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * len(raw)  # 20 and more, where all bytes were hashed at once


def test_gru_sums_runs_of_any_length():
    """Gradients of words that are read seldom, often and very often add up as row by row."""
    gru = lm.gru
    lengths = np.array([1, gru.LONG_RUN + 1, 2, 1, gru.LONG_RUN, 7, 300, 1])
    rows = np.random.default_rng(3).normal(size=(lengths.sum(), 5))
    starts = np.cumsum(lengths) - lengths
    assert np.allclose(gru._run_sums(rows, starts), np.add.reduceat(rows, starts, axis=0))
    assert np.allclose(gru._run_sums(rows[:3], np.arange(3)), rows[:3]) and gru._run_sums(rows[:0], starts[:0]).shape == (0, 5)
