"""Language-model scores of whole texts by a gated recurrent model, beside a smoothed unigram base.

Tokens are the white-space separated words of a text, A-Z as a-z, and one end. Counts are taken over all training
documents, on 64-bit hashes of the words: each task counts its own, one shuffle adds them up.

The recurrent model knows the most frequent tokens, as many as make up COVER of all, within LEAST_WORDS and MOST_WORDS; every other word is first predicted as one unknown
word and then among the other words by (c + 1) / (their counts + their number + 1), so the probabilities of all words
and of one unseen word add up to 1. Its weights start on a bounded sample on the driver and then train on all training
documents, once each, in ROUNDS rounds: a round deals its documents to shards by their ids, a task trains each of its shards by
truncated backpropagation with one optimiser from its first document to its last, and the average of all shards by their
numbers of tokens, in two levels of groups, starts the next round. State is carried from window to window through a
text; a text of more than SEGMENT tokens trains in segments, of which each later one first reads the WARM tokens
before it. Shards depend on ids and on the number of tokens, not on how the table is partitioned. Scoring reads each text
whole: its state is carried across windows from the first word to the end.

Counts of the COMMON most frequent words are broadcast (a fixed bound); the rarer words of each document go
through a join on their hash, which has no hot keys, as all of them are rare.

Defined results: a null or empty text is its end alone; null ids are scored and don't train; repeated rows count as
often as they come and score alike; without training documents every word is unseen, N is 0 and the model is
uniform over end and unknown; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm import gru
from lakesift.llm.common import Scratch, table
from lakesift.llm.toxicity import fold
from lakesift.llm.wordhash import row_chunks, text_buffers, word_hashes

COVER, LEAST_WORDS, MOST_WORDS = 0.75, 1024, 4096
COMMON = 1 << 18
HELD_WORDS = 400_000  # distinct words a task holds counts of at a time
SEGMENT, WARM = 1024, gru.WINDOW
START_DOCS = 400
START_BYTES = 16 << 10
LANES, TRAIN_LANES = 256, 512
START_RATE, RATE = 0.01, 0.015
CHUNK = 3 << 20  # bytes of text scored together
HASHED = 1 << 19  # bytes of text hashed together
END = np.uint64(0xE0D0FA11D0C5)
PART = 8192  # weights in a block of the average
ROUNDS = 2
SHARD = 1 << 20  # tokens of a shard at least; larger tables have more shards, and larger ones
SPREAD = 4  # partitions for each shard, so that few shards meet in one
HELD = 1 << 19  # tokens that are dealt to lanes together


def _token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an end for each row, tokens of each row). Bytes are hashed in parts, whose helper arrays take many times their room."""
    parts = [word_hashes(raw, offsets[at : to + 1]) for at, to in row_chunks(offsets, HASHED)]
    words, counts = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else word_hashes(raw, offsets)
    lengths = counts + 1
    out = np.full(lengths.sum(), END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
    return out, lengths


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(words.view(np.int64)), pa.array(counts)], names=["h", "c"])

    for batch in batches:
        raw, offsets = text_buffers(batch.column(0))
        for at, to in row_chunks(offsets):
            hashes, _ = _token_hashes(raw, offsets[at : to + 1])
            new, n = np.unique(hashes, return_counts=True)
            words, back = np.unique(np.concatenate([words, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(words)).astype(np.int64)
            if len(words) >= HELD_WORDS:
                yield out()
                words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield out()


class Vocabulary:
    """Sorted hashes of the model's words with their numbers; the unknown word has a number too."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        known = hashes != END
        ends = int(counts[~known].sum())
        words, own = hashes[known], counts[known]
        most = int(np.searchsorted(np.cumsum(own), COVER * (total - ends))) + 1
        most = min(max(most, LEAST_WORDS), MOST_WORDS) - 2
        words, own = words[:most], own[:most]
        self.rest = int(total - own.sum() - ends)
        self.rest_words = int(distinct - len(words) - (ends > 0))
        every = np.concatenate([own, [ends, self.rest]])
        order = np.argsort(-every, kind="stable")
        number = np.empty(len(every), np.int64)
        number[order] = np.arange(len(every))
        self.counts = every[order]
        self.end, self.unknown = int(number[-2]), int(number[-1])
        keys = np.concatenate([words, [END]]).astype(np.uint64)
        by = np.argsort(keys)
        self.keys, self.numbers = keys[by], number[:-1][by]
        self.limits = gru.class_limits(self.counts)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.numbers[at], self.unknown)


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, warm) of the segments of all rows, which follow one another: warm tokens are those of the segment before."""
    many = -(-lengths // SEGMENT)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    own = np.minimum(SEGMENT, np.repeat(lengths, many) - nth * SEGMENT)
    warm = np.where(nth > 0, WARM, 0)
    return np.cumsum(own) - own - warm, own + warm, warm


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(shard, its rows) for each run of rows of one shard."""
    for batch in batches:
        if batch.num_columns == 1:
            yield TaskContext.get().partitionId(), batch
            continue
        of = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        yield from ((int(of[at]), batch.slice(at, to - at)) for at, to in pairwise(cuts) if to > at)


def _trained(shared, planned: float = HELD, rate: float = RATE, last: float = RATE / 10):
    """One row for each block of a shard's weights, after training on all documents of the shard.

    Batches have texts and the numbers of their shards, which follow one another; without numbers a task is one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own in groupby(_by_shard(batches), lambda x: x[0]):
            yield from one(shard, (batch for _, batch in own))

    def one(shard: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words = shared.value
        trainer = gru.Trainer(w, words.limits, words.end, rate, last, planned, TRAIN_LANES)
        total, waiting = 0, 0
        held: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def learn() -> None:
            nonlocal waiting
            if held:
                trainer.learn(np.concatenate(held), *_segments(np.concatenate(rows)))
            held.clear()
            rows.clear()
            waiting = 0

        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for at, to in row_chunks(offsets):
                hashes, lengths = _token_hashes(raw, offsets[at : to + 1])
                held.append(words.number(hashes))
                rows.append(lengths)
                total += len(hashes)
                waiting += len(hashes)
                if waiting >= HELD:
                    learn()
        learn()
        if total:
            flat = _flat(trainer.w)
            parts = [flat[i : i + PART].tobytes() for i in range(0, len(flat), PART)]
            yield pa.record_batch(
                [pa.array([shard] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary()), pa.array([float(total)] * len(parts))],
                names=["shard", "part", "weights", "tokens"],
            )

    return run


WEIGHTS = "shard long, part long, weights binary, tokens double"


def _averaged(group: pa.Table) -> pa.Table:
    group = group.sort_by("shard")
    tokens = group.column("tokens").to_numpy()
    total = sum(np.frombuffer(b.as_py(), np.float32) * n for b, n in zip(group.column("weights"), tokens, strict=True))
    row = {
        "shard": group.column("shard")[0].as_py(), "part": group.column("part")[0].as_py(),
        "weights": (total / tokens.sum()).astype(np.float32).tobytes(), "tokens": float(tokens.sum()),
    }
    return pa.Table.from_pylist([row])


def _shards(tokens: float) -> int:
    """How many shards so many tokens make: both their number and their size grow with the square root."""
    return max(1, math.ceil(tokens / max(SHARD, math.sqrt(tokens * (SHARD >> 4)))))


def fit(train: DataFrame, words: Vocabulary) -> dict:
    """Weights from all training documents (id, text)."""
    spark = train.sparkSession
    w = gru.start(words.counts)
    short = train.filter((F.octet_length("text") <= START_BYTES) & (F.octet_length("text") > 0))
    sample = short.orderBy(F.xxhash64("text"), "text").limit(START_DOCS).select("text").toArrow().column("text")
    if not len(sample):
        return w
    hashes, lengths = _token_hashes(*text_buffers(sample))
    w = gru.train(w, words.limits, words.number(hashes), np.cumsum(lengths) - lengths, lengths, words.end, START_RATE, 32, 2)
    tokens = float(words.counts.sum()) / ROUNDS
    shards = _shards(tokens)
    near = math.ceil(math.sqrt(shards))
    lot = F.xxhash64(F.lit("lot"), "id")
    for turn in range(ROUNDS):
        rate, last = (RATE * (1 - 0.9 * k / ROUNDS) for k in (turn, turn + 1))
        shared = spark.sparkContext.broadcast((w, words))
        # Shards are a column: as many are trained, and as many weights move, whatever the number of partitions that hold them.
        own = train.filter(F.pmod(lot, F.lit(ROUNDS)) == turn).withColumn("shard", F.pmod(F.hash(F.xxhash64("id")), F.lit(shards)))
        own = own.repartition(SPREAD * shards, "shard").sortWithinPartitions("shard", "id", F.xxhash64("text")).select("text", "shard")
        own = own.mapInArrow(_trained(shared, tokens / shards, rate, last), WEIGHTS)
        own = own.groupBy("part", (F.col("shard") % near).alias("near")).applyInArrow(_averaged, WEIGHTS)
        done = own.groupBy("part").applyInArrow(_averaged, WEIGHTS).orderBy("part").toArrow()
        if done.num_rows:
            w = _shaped(np.concatenate([np.frombuffer(b.as_py(), np.float32) for b in done.column("weights")]), w)
    return w


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words, keys, logs = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for at, to in row_chunks(offsets, CHUNK):
                hashes, lengths = _token_hashes(raw, offsets[at : to + 1])
                starts = np.cumsum(lengths) - lengths
                ids = words.number(hashes)
                lm = gru.score_rows(w, words.limits, ids, starts, lengths, words.end, LANES) / np.log(10)
                distinct, back = np.unique(hashes, return_inverse=True)
                place = np.searchsorted(keys, distinct)
                place[place == len(keys)] = 0
                common = keys[place] == distinct if len(keys) else np.zeros(len(distinct), bool)
                log = np.where(common, logs[place] if len(keys) else 0.0, 0.0)[back]
                known = common[back]
                other = ids == words.unknown
                sums = lambda v: np.add.reduceat(v, starts)  # noqa: E731  every row has its end at least
                # What is rare stays open: a word once for each row, with how often it comes.
                rare = np.flatnonzero(~known)
                owner = np.repeat(np.arange(len(lengths)), lengths)[rare]
                by = np.lexsort((hashes[rare], owner))
                h, o = hashes[rare][by], owner[by]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, int)
                times = np.diff(np.append(new, len(h)))
                limits = pa.array(np.searchsorted(o[new], np.arange(len(lengths) + 1)).astype(np.int32))
                yield pa.record_batch(
                    [
                        pa.array(row + np.arange(len(lengths))), batch.column(0).slice(at, to - at), pa.array(lengths),
                        pa.array(sums(known.astype(np.int64))), pa.array(sums(log)), pa.array(lm), pa.array(sums(np.where(other, log, 0.0))),
                        pa.array(sums(other.astype(np.int64))),
                        pa.ListArray.from_arrays(limits, pa.array(h[new].view(np.int64))),
                        pa.ListArray.from_arrays(limits, pa.array(times.astype(np.int32))),
                    ],
                    names=["row", "id", "n_tokens", "n_known", "log", "lm", "other_log", "other", "rare", "times"],
                )
                row += len(lengths)

    return run


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    own = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    train = own.filter(~F.coalesce(held_out(F.col("id")), F.lit(True)))
    counts = scratch.write(train.select("text").mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = counts.orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    keys, c = common.column("h").to_numpy().astype(np.int64).view(np.uint64), common.column("c").to_numpy().astype(np.int64)
    words = Vocabulary(keys, c, total, distinct)
    w = fit(train, words)
    by = np.argsort(keys)
    shared = spark.sparkContext.broadcast((w, words, keys[by], np.log10(c[by] + 1.0)))
    kind = own.schema["id"].dataType
    spec = (
        f"row long, id {kind.simpleString()}, n_tokens long, n_known long, log double, lm double, other_log double, other long, "
        "rare array<long>, times array<int>"
    )
    parts = scratch.write(own.mapInArrow(_scored(shared), spec), "parts")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("h"), F.col("r.times").alias("n"))
    rare = rare.join(counts, "h").groupBy("row").agg(
        F.sum("n").alias("found"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("found_log")
    )
    full = parts.drop("rare", "times").join(rare, "row", "left")
    found, found_log = F.coalesce("found", F.lit(0)), F.coalesce("found_log", F.lit(0.0))
    base = float(np.log10(total + distinct + 1))
    among = float(np.log10(words.rest + words.rest_words + 1))
    return full.select(
        F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("n_known") + found).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log") + found_log - F.col("n_tokens") * base).alias("base_score"),
        (F.col("lm") + F.col("other_log") + found_log - F.col("other") * among).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), lambda key: fold(key, 7, 2))
