"""Decontamination, the prefix trie and resampling against brute force, on odd tables and with clashing columns."""

import collections
import hashlib
import math
import random
import re
import types
import zlib

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from lakesift.llm import decontaminate, mixing, prefix_trie, quality, resample
from lakesift.llm.common import Scratch, scratch_root
from lakesift.llm.ordering import sorted_blocks, with_places

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "The quick, brown FOX!", "x"), (4, "The quick, brown FOX!", "x"), (None, "the quick brown fox", None),
    (5, "word " * 3000, "x"), (6, "ÄÖ q-u-i-c-k\x0bÉ１", "x"), (7, "a" * 20000, "x"), (8, "say the quick brown fox jumps over the lazy dog again and again today", "x"),
    (9, "one the quick brown fox jumps over the lazy dog", "x"),
]
ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "quick brown"), (3, None), (4, "!!"), (None, "word word word"), (10, "again and again"), (2, "a fox")]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_hits(docs, items, window):
    tests = collections.defaultdict(set)
    for item, text in items:
        own = words(text)
        for k in range(max(1, len(own) - window + 1)) if own else ():
            tests[tuple(own[k : k + window])].add(item)
    out = []
    for doc, text in docs:
        own, hit, met = words(text), set(), set()
        for k in {len(t) for t in tests}:
            for i in range(len(own) - k + 1):
                if tuple(own[i : i + k]) in tests:
                    hit.update(range(i, i + k))
                    met |= tests[tuple(own[i : i + k])]
        out.append((doc or 0, len(own), len(hit), sorted(str(i) for i in met if i is not None)))
    return sorted(out)


@pytest.fixture(scope="module")
def odd(spark):
    # The extra columns bear names that the operators use themselves.
    return spark.createDataFrame([(*r, "k", 1) for r in ODD], "doc_id long, text string, row string, hits string, rank int").cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*i, "z") for i in ITEMS], "item_id long, text string, window string")


@pytest.mark.parametrize(("window", "block_bytes"), [(10, 1 << 20), (3, 1 << 20), (3, 200), (4, 90)])
def test_hits_equal_brute_force_in_one_block_and_many(odd, items, window, block_bytes):
    found = decontaminate.find(odd, items, window, block_bytes=block_bytes)
    got = found.select("row.doc_id", "n_words", decontaminate.n_hit().alias("n"), "items").collect()
    assert sorted((r[0] or 0, r[1], r[2], sorted(r[3])) for r in got) == brute_hits([r[:2] for r in ODD], ITEMS, window)


def test_windows_that_share_a_hash_are_told_apart():
    block = decontaminate.make_block([("a b", "1"), ("c d", "2")], 2)
    same = decontaminate.Block(block.places, {2: block.hashes[2][[0, 0]]}, block.texts, block.items, block.seen)
    import numpy as np

    for text, item in (("a b", "1"), ("c d", "2")):
        raw = np.frombuffer(text.encode(), np.uint8)
        _, hits, named = decontaminate._meet(same, raw, np.array([0, len(raw)]), [None])
        real = decontaminate.window_hashes(decontaminate.word_hashes(raw, np.array([0, len(raw)]))[0], 2, block.places)[0] == block.hashes[2][0]
        assert (named == [{item}]) == real and bool(hits[0]) == real


def test_spans_and_documents_are_removed(spark, odd, items):
    cut = {(r.doc_id, r.text) for r in decontaminate.remove_spans(odd, items, window=3).collect()}
    assert (8, "say  today") in cut and (2, "") in cut and (1, None) in cut and (4, "!") in cut and (5, " ") in cut
    kept = decontaminate.remove_documents(odd, items, window=3)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 6, 7}
    assert decontaminate.remove_documents(odd, items, 30.0, window=3).filter("doc_id = 5").count() == 0


def test_decontamination_of_empty_tables(odd, items):
    assert decontaminate.find(odd.limit(0), items).count() == 0
    assert decontaminate.find(odd, items.limit(0)).filter(decontaminate.n_hit() > 0).count() == 0


def brute_weights(docs, target, plan):
    def runs(text):
        own = words(text)
        return [" ".join(own[i : i + k]) for k in range(1, plan.most_words + 1) for i in range(len(own) - k + 1)]

    def bucket(run):
        return zlib.crc32(run.encode()) % plan.buckets

    s, t = (collections.Counter(bucket(f) for _, text in rows for f in runs(text)) for rows in (docs, target))
    n = plan.buckets

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (s.total() + n) / ((s[b] + 1) * (t.total() + n))))

    scored = []
    for doc, text in docs:
        weight = sum(gain(bucket(f)) for f in runs(text))
        h = int(hashlib.sha256(f"{plan.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((doc, len(runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    may = sorted((r for r in scored if r[4] >= plan.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(may[: len(may) * plan.draw_percent // 100])]
    rest = may[len(drawn) :] + [r for r in scored if r[4] < plan.least_words]
    return sorted((str((*r[:4], None)) for r in rest), key=str) + sorted(map(str, drawn))


@pytest.mark.parametrize("plan", [resample.Plan(), resample.Plan(3, 50, "s", 1, 60), resample.Plan(2, 7, "t", 0, 100)])
def test_weights_and_draws_equal_brute_force(spark, odd, items, plan):
    got = resample.resample(odd, items, plan).collect()
    rows = [tuple(r) for r in got]
    mine = sorted(str(r) for r in rows if r[4] is None) + sorted(str(r) for r in rows if r[4] is not None)
    assert mine == brute_weights([r[:2] for r in ODD], [i[:2] for i in ITEMS], plan)
    drawn = resample.draw(odd, items, plan)
    assert drawn.columns == odd.columns and {r.doc_id for r in drawn.collect()} == {r[0] for r in rows if r[4] and r[0] is not None}


def test_tries_emptied_early_change_nothing(monkeypatch, odd, items):
    plan = resample.Plan(2, 97)
    monkeypatch.setattr(resample, "MOST_NODES", 5)
    small, large = resample.Trie(plan), resample.Trie(plan)
    for r in ODD:
        small.count(resample.words_of((r[1] or "").encode()))
    small.fold()
    monkeypatch.setattr(resample, "MOST_NODES", 1 << 20)
    for r in ODD:
        large.count(resample.words_of((r[1] or "").encode()))
    large.fold()
    assert (small.totals == large.totals).all() and large.totals.sum() == sum(resample.features(len(words(r[1])), 2) for r in ODD)


def test_resampling_of_empty_tables(odd, items):
    assert resample.resample(odd.limit(0), items).count() == 0
    assert {r.n_features for r in resample.resample(odd, items.limit(0)).collect()} == {len(words(r[1])) for r in ODD}


def test_places_over_blocks(spark):
    rows = [(i * 7919) % 1000 for i in range(1000)] + [5] * 50
    blocks = sorted_blocks(spark.createDataFrame([(x, k) for k, x in enumerate(rows)], "x int, k int"), ["x", "k"], Scratch(spark, "t"), "t", 100)
    got = sorted((r.place, r.x) for r in with_places(blocks, "place").collect())
    assert got == list(enumerate(sorted(rows), 1))


def digest(turn):
    return hashlib.sha256(turn.encode()).hexdigest()[: prefix_trie.DIGEST]


def brute_trie(seqs, size):
    members, below = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for n in members:
        if n:
            below[n[:-1]].append(n)
    out = []

    def walk(n):
        got = [walk(k) for k in below[n]]
        leaves = sum(g[0] for g in got) or 1
        saved = sum(g[1] for g in got) + (len(members[n]) - 1) * (size[n[-1]] if n else 0)
        ends = ",".join(str(c) for c in sorted(members[n]) if len(seqs[c]) == len(n))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(got), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if seqs:
        walk("")
    return sorted(map(str, out))


@pytest.mark.parametrize(("seed", "rows", "block_rows"), [(1, 1, 7), (2, 5, 1), (3, 60, 3), (4, 90, 10), (5, 40, 10**6)])
def test_tries_equal_brute_force_over_blocks(spark, seed, rows, block_rows):
    r = random.Random(seed)
    size = {x: r.randint(0, 9) for x in "abc"}
    common = "".join(r.choice("abc") for _ in range(4 * (seed % 2)))
    seqs = {c: (common + "".join(r.choice("abc") for _ in range(r.randint(0, 4))))[: r.choice([9, 9, 2])] for c in r.sample(range(1000), rows)}
    turns = spark.createDataFrame([(c, [(digest(x), size[x]) for x in s]) for c, s in seqs.items()], "conv long, turns array<struct<digest:string,words:int>>")
    assert sorted(str(tuple(x)) for x in prefix_trie.trie(turns, block_rows).collect()) == brute_trie(seqs, size)


def test_conversations_of_odd_rows(spark):
    rows = [(1, None, "user", "hi"), (1, 0, None, None), (1, 1, "user", "a b"), (1, 1, "user", "a b"), (2, 0, "user", "hi"), (None, 0, "user", "lost"), (40, 1, "user", "x y z"), (41, 1, "user", "q")]
    table = spark.createDataFrame([(*x, "k", 3) for x in rows], "conv_id long, turn long, role string, text string, conv string, digest int")
    turns = {r.conv: [t.words for t in r.turns] for r in prefix_trie.sequences(table).collect()}
    assert turns == {1: [1, 0, 2, 2], 2: [1], 40: [3], 41: [1]}
    nodes = prefix_trie.trie(prefix_trie.sequences(table)).collect()
    root = next(r for r in nodes if r.depth == 0)
    assert (root.conv_id, root.parent_conv_id, root.n_convs, root.n_children) == (1, None, 4, 3)
    assert sum(r.n_convs for r in nodes if r.depth == 1) == 4
    assert prefix_trie.trie(prefix_trie.sequences(table.limit(0))).count() == 0


def test_rebuilt_conversations(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    turns = {r.conv: [t.digest for t in r.turns] for r in prefix_trie.sequences(table).collect()}
    got = {r.conv: [t.digest for t in r.turns] for r in prefix_trie.rebuild(prefix_trie.sequences(table)).collect()}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        assert got[c] == turns.get(c - c % 20, [])[:h] + own[h:]


def test_scratch_folder_is_shared_on_a_cluster(tmp_path):
    held = types.SimpleNamespace(isDefined=lambda: False)
    scala = types.SimpleNamespace(getCheckpointDir=lambda: held)
    made = []
    context = types.SimpleNamespace(master="spark://host:7077", _jsc=types.SimpleNamespace(sc=lambda: scala), setCheckpointDir=made.append)
    unset = types.SimpleNamespace(conf={}, sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(unset)
    context.master = "local[2]"
    assert scratch_root(unset) == made[0] and made[0].startswith("file:///")
    unset.conf["spark.checkpoint.dir"] = "hdfs://host/shared"
    assert scratch_root(unset) == "hdfs://host/shared"


def test_shards_hold_the_mix(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mixing.write_shards(docs, f"{tmp_path}/mix")
    got = spark.read.parquet(f"{tmp_path}/mix")
    count = lambda rows: collections.Counter(r.doc_id for r in rows)
    assert set(docs.columns) < set(got.columns)
    assert count(got.select("doc_id").collect()) == count(mixing.draw_documents(docs).select("doc_id").collect())
    want = collections.Counter()
    for r in mixing.query(spark, SMALL).select("doc_id", "shards").collect():
        want.update((r.doc_id, int(x)) for x in filter(None, r.shards.split(",")))
    assert collections.Counter((r.doc_id, int(r.shard)) for r in got.select("doc_id", "shard").collect()) == want
    # A shard's files don't keep the order of the table they were drawn from.
    files = collections.defaultdict(list)
    for r in got.select("doc_id", F.input_file_name().alias("f")).collect():
        files[r.f].append(r.doc_id)
    assert any(ids != sorted(ids) for ids in files.values())


def test_quality_keeps_columns_of_any_name(spark):
    rows = [(i, f"A line of words number {i}, which ends well. " * 9, *[f"{c}{i}" for c in quality.STEPS]) for i in range(3)]
    plain = spark.createDataFrame(rows, ["doc_id", "text", *quality.STEPS])
    own = quality.judge(plain)
    bare = quality.judge(plain.select("doc_id", "text"))
    assert own.columns == [*plain.columns, *[c for c in bare.columns if c not in plain.columns]]
    assert own.select(plain.columns).orderBy("doc_id").collect() == [tuple(r) for r in rows]
    assert own.select(bare.columns).orderBy("doc_id").collect() == bare.orderBy("doc_id").collect()
    moved = plain.drop("text").withColumn("_body", F.lit(rows[0][1]))
    assert {r.n_words for r in quality.judge(moved, text="_body").collect()} == {bare.first().n_words}


def test_quality_lines_are_cut_once(spark):
    """The tests of a line share its words and its lower form, which were made anew for every one of them."""
    from lakesift.llm import quality

    docs = spark.createDataFrame([(1, "a line\nterms of use")], "doc_id long, text string")
    test = str(quality._line_fails(docs["text"], quality.Rules())._jc.toString())
    assert test.count("lower(") == 1 and test.count("split(") == 1
