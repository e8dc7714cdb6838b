"""Target-distribution importance resampling over hashed word features, with partition-local word tries.

Every task keeps a trie of the word runs that it has met: a node holds the run's count and the state of its
CRC, from which a child's state follows with the child's word alone. A pass over each of the two tables adds
the nodes' counts up by bucket; a second pass over the documents walks the same paths with each node's gain, the
logarithm of the target's share of a bucket over the corpus's. Bucket totals have a size fixed by `buckets`, so
they may pass the driver and be broadcast. A trie is emptied when it holds MOST_NODES nodes, its counts added up
first: that bounds a task's memory and changes no result. Documents are drawn by the highest sums of weight and
Gumbel noise made from their ids; ranks come from sorted key ranges, so no task sees all documents.

Defined results: null and empty texts have no feature and weigh 0; a null id counts as an empty one in the
noise and comes last in ties; repeated rows score alike and take ranks one after the other; empty tables give empty
tables or, for the target, counts of 0. Other columns of the input don't matter.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import Scratch, table
from lakesift.llm.ordering import sorted_blocks, with_places
from lakesift.llm.wordhash import text_buffers
from lakesift.llm.wordruns import words_of

MOST_NODES = 1 << 20
RUN_WORDS = 1 << 16


@dataclass(frozen=True)
class Plan:
    most_words: int = 1  # the longest run of words that is a feature
    buckets: int = 10_000
    seed: str = "2024"
    least_words: int = 20  # documents with fewer are never drawn
    draw_percent: int = 10


class _Children(dict):
    """A node's children by word; a word that is looked up and missing becomes a node."""

    __slots__ = ("state", "trie")

    def __init__(self, trie: Trie, state: int | None):
        self.trie, self.state = trie, state

    def __missing__(self, word: bytes) -> int:
        node = self[word] = self.trie.add(zlib.crc32(word) if self.state is None else zlib.crc32(word, zlib.crc32(b" ", self.state)))
        return node


class Trie:
    """Word runs of up to so many words. Nodes are numbers; gains, if given, are by bucket."""

    def __init__(self, plan: Plan, gains: np.ndarray | None = None):
        self.plan, self.gains = plan, gains
        self.totals = np.zeros(plan.buckets, np.int64)
        self.empty()

    def empty(self) -> None:
        self.states: list[int] = []
        self.children: list[_Children] = []
        self.counts = np.zeros(1024, np.int64)
        self.gain = np.zeros(1024, np.int64)
        self.root = _Children(self, None)

    def add(self, state: int) -> int:
        self.states.append(state)
        if self.plan.most_words > 1:
            self.children.append(_Children(self, state))
        n = len(self.states)
        if n > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(n, np.int64)])
            self.gain = np.concatenate([self.gain, np.zeros(n, np.int64)])
        if self.gains is not None:
            self.gain[n - 1] = self.gains[state % self.plan.buckets]
        return n - 1

    def paths(self, words: list[bytes]) -> Iterator[list[int]]:
        """The nodes of all runs of one word, of two, and so on; runs start at every word."""
        nodes = list(map(self.root.__getitem__, words))
        yield nodes
        for k in range(1, self.plan.most_words):
            nodes = [self.children[a][w] for a, w in zip(nodes, itertools.islice(words, k, None), strict=False)]
            yield nodes

    def fold(self) -> None:
        """Adds the counts up by bucket and empties the trie."""
        if self.states:
            at = np.array(self.states, np.int64) % self.plan.buckets
            np.add.at(self.totals, at, self.counts[: len(at)])
        self.empty()

    def count(self, words: list[bytes]) -> None:
        for part in self.parts(words):
            for nodes in self.paths(part):
                self.counts[: len(self.states)] += np.bincount(np.array(nodes, np.int64), minlength=len(self.states))

    def weigh(self, words: list[bytes]) -> int:
        return sum(int(self.gain[np.array(nodes, np.int64)].sum()) for part in self.parts(words) for nodes in self.paths(part))

    def parts(self, words: list[bytes]) -> Iterator[list[bytes]]:
        if len(self.states) > MOST_NODES:
            self.fold()
        yield words


def features(n_words: int, most: int) -> int:
    return sum(max(0, n_words - k) for k in range(most))


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[bytes]:
    raw, offsets = text_buffers(batch.column(k))
    for a, b in itertools.pairwise(offsets.tolist()):
        yield raw[a:b].tobytes()


def _counted(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(plan)
        for batch in batches:
            held: list[bytes] = []
            for text in _texts(batch, 0):
                if plan.most_words > 1:
                    trie.count(words_of(text))
                    continue
                held += words_of(text)
                if len(held) >= RUN_WORDS:
                    trie.count(held)
                    held = []
            trie.count(held)
        trie.fold()
        at = np.flatnonzero(trie.totals)
        yield pa.record_batch([pa.array(at), pa.array(trie.totals[at])], names=["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, plan: Plan, text: str = "text") -> np.ndarray:
    """Features of all rows by bucket."""
    own = texts.select(F.col(text).cast("string").alias("text"))
    rows = own.mapInArrow(_counted(plan), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(plan.buckets, np.int64)
    for r in rows:  # as many as buckets at most
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: 1000 times the logarithm of the smoothed target share over the smoothed own share, rounded down."""
    n, s, t = len(own), own.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weighed(plan: Plan, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(plan, shared.value)
        for batch in batches:
            n, weights = [], []
            for text in _texts(batch, 1):
                words = words_of(text)
                n.append(len(words))
                weights.append(trie.weigh(words))
            sums = [features(k, plan.most_words) for k in n]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(weights, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return run


def noise(key: Column, seed: str) -> Column:
    """Gumbel noise of a key in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every row of docs; rank is null where a row isn't drawn."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(gains(bucket_totals(own, plan), bucket_totals(target, plan, target_text)))
    scored = own.mapInArrow(_weighed(plan, shared), "id long, n_words long, n_features long, weight long")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("id"), plan.seed))
    order = [(F.col("n_words") < plan.least_words).asc(), F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features")]
    blocks = sorted_blocks(scored, order, scratch, "scored")
    draws = blocks.filter(F.col("n_words") >= plan.least_words).count() * plan.draw_percent // 100
    placed = with_places(blocks, "place")  # those that may be drawn come first
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("place") <= draws, F.col("place")).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of docs; rows that share an id are drawn together. Rows without an id can't be told apart and stay out."""
    drawn = resample(docs, target, plan, id_col, **options).filter("rank IS NOT NULL").select(id_col).distinct()
    return docs.join(drawn.hint("merge"), id_col, "left_semi").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crcs),
doc AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
item AS (SELECT {_WORDS} AS w FROM benchmark),
own AS (SELECT rid, unnest(w) AS f FROM doc),
asked AS (SELECT unnest(w) AS f FROM item),
bytes AS (SELECT f, list_transform(range(octet_length(encode(f))), lambda k: ('0x' || hex(encode(f))[2 * k + 1:2 * k + 2])::BIGINT) AS b FROM (SELECT f FROM own UNION SELECT f FROM asked)),
bucket AS (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(c // 256, crcs[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 10000 AS k
  FROM bytes, crc_table),
s AS (SELECT k, count(*) AS n FROM own JOIN bucket USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM asked JOIN bucket USING (f) GROUP BY k),
total AS (SELECT (SELECT count(*) FROM own) AS s, (SELECT count(*) FROM asked) AS t),
gain AS (
  SELECT s.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (total.s + 10000) / ((s.n + 1)::DOUBLE * (total.t + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t ON s.k = t.k, total),
weight AS (SELECT rid, sum(g)::BIGINT AS g FROM own JOIN bucket USING (f) JOIN gain USING (k) GROUP BY rid),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(g, 0)::BIGINT AS weight,
    coalesce(g, 0)::BIGINT + CAST(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM doc LEFT JOIN weight USING (rid)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank
FROM ranked"""
