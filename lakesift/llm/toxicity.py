"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (MIN_N to MAX_N bytes of UTF-8, A-Z as a-z, with marks for the word's
ends) and of the word itself, hashed into BUCKETS; each bucket has a vector. The vectors of a word, and then of the
words of a window, are averaged, and a linear softmax over two classes turns the average into a probability.
Misspellings that were never seen share most n-grams, hence vectors, with the words they come from. A text's score is
that of its worst window; windows of WINDOW words, half overlapping, cover the whole text, so one passage counts the
same in a short and in a long text. Vectors and softmax are trained together by Adagrad on the worst window of each
labelled text, in the driver's numpy.

The classifier is fitted on a bounded sample: of the labelled training rows of each class the SAMPLE with the
smallest hash of the id, their texts whole. The share of class 1 among all labelled training rows sets
the prior of the scores. Scoring is one pass without a shuffle: because averages and the softmax's logit are linear,
a worker needs one number for each bucket, and it meets each distinct word of a chunk once.

Defined results: a null or empty text has no window and gets the score of the bias alone; without labels of both
classes every score is the prior (0 if there are no labels); null labels or ids don't train; of rows that
repeat an id the first text in order trains; repeated rows score alike; an empty table gives an empty table. labels, lang, source and doc_id are no input of a score. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import table
from lakesift.llm.wordhash import mix, row_chunks, text_buffers, word_hashes, word_spans

MIN_N, MAX_N = 3, 6
BUCKETS = 1 << 17
SIZE = 12  # of a vector
WINDOW = 8
SAMPLE = 2500  # labelled rows of each class
EPOCHS = 6
BATCH = 128
RATE = 0.5
THRESHOLD = 0.3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTOR = np.random.default_rng(11).integers(1, 2**63, (MAX_N + 1, MAX_N), dtype=np.uint64) | np.uint64(1)


@dataclass
class Model:
    vectors: np.ndarray  # (BUCKETS, SIZE)
    weights: np.ndarray  # (SIZE,): of class 1 against class 0
    bias: float

    def bucket_logits(self) -> np.ndarray:
        return (self.vectors @ self.weights).astype(np.float32)


def word_buckets(own: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words, buckets of each): n-grams of <word> and the word itself, word by word."""
    size = ends - starts
    total = size + 2
    first = np.concatenate([[0], np.cumsum(total)])
    text = np.full(first[-1], 62, np.uint8)
    text[first[:-1]] = 60
    inner = np.repeat(first[:-1] + 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text[inner] = _LOWER[own[np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]]
    wide = text.astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(size)), total)
    left = np.repeat(first[1:], total) - np.arange(len(text))
    found, whose = [(mix(hashes) % np.uint64(BUCKETS)).astype(np.int64)], [np.arange(len(size))]
    for n in range(MIN_N, MAX_N + 1):
        at = np.flatnonzero(left >= n)
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h += wide[at + k] * _FACTOR[n, k]
        found.append((mix(h) % np.uint64(BUCKETS)).astype(np.int64))
        whose.append(owner[at])
    whose_all = np.concatenate(whose)
    order = np.argsort(whose_all, kind="stable")
    return np.concatenate(found)[order], np.bincount(whose_all, minlength=len(size))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, row) of the windows of rows with so many words each."""
    step = WINDOW // 2
    many = np.where(counts == 0, 0, 1 + np.maximum(0, -(-(counts - WINDOW) // step)))
    row = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = np.minimum(nth * step, np.maximum(0, counts[row] - WINDOW))
    base = np.cumsum(counts) - counts
    return base[row] + begin, np.minimum(WINDOW, counts[row]), row


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; no run is empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes, axis=0)


class Training:
    """Labelled texts as words, words as buckets."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        raw, offsets = text_buffers(pa.array(texts, pa.string()))
        known, buckets, sizes = np.zeros(0, np.uint64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        every, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at, to in row_chunks(offsets):  # a part at a time, for the driver's memory
            hashes, n = word_hashes(raw, offsets[at : to + 1])
            own, starts, ends, _ = word_spans(raw, offsets[at : to + 1])
            distinct, first = np.unique(hashes, return_index=True)
            new = ~np.isin(distinct, known)
            if new.any():
                first = first[new]
                found, many = word_buckets(own, starts[first], ends[first], hashes[first])
                buckets.append(found)
                sizes.append(many)
                known = np.concatenate([known, distinct[new]])
            every.append(hashes)
            counts.append(n)
        self.counts, self.sizes = np.concatenate(counts), np.concatenate(sizes)
        self.buckets = np.concatenate(buckets).astype(np.int32)
        order = np.argsort(known)
        self.words = order[np.searchsorted(known[order], np.concatenate(every))]
        self.at = np.cumsum(self.sizes) - self.sizes
        self.w_start, self.w_size, self.w_row = windows(self.counts)
        self.labels = labels
        self.model = Model(
            np.random.default_rng(5).uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)), np.linspace(-0.5, 0.5, SIZE), 0.0
        )
        self.sq_vectors, self.sq_weights, self.sq_bias = np.full(BUCKETS, 1e-6), np.full(SIZE, 1e-6), 1e-6

    def logits(self) -> np.ndarray:
        """Of every window."""
        word = _sums(self.model.bucket_logits()[self.buckets], self.sizes) / self.sizes
        run = np.concatenate([[0.0], np.cumsum(word[self.words])])
        return (run[self.w_start + self.w_size] - run[self.w_start]) / self.w_size + self.model.bias

    def worst(self) -> np.ndarray:
        """The window with the largest logit of each row that has any."""
        order = np.lexsort((self.logits(), self.w_row))
        return order[np.flatnonzero(np.append(self.w_row[order][1:] != self.w_row[order][:-1], True))] if len(order) else order

    def step(self, picked: np.ndarray) -> None:
        m = self.model
        words = self.words[_spread(self.w_start[picked], self.w_size[picked])]
        distinct, back = np.unique(words, return_inverse=True)
        size = self.sizes[distinct]
        buckets = self.buckets[_spread(self.at[distinct], size)]
        vectors = _sums(m.vectors[buckets], size) / size[:, None]
        mean = _sums(vectors[back], self.w_size[picked]) / self.w_size[picked][:, None]
        p = 1 / (1 + np.exp(-np.clip(mean @ m.weights + m.bias, -30, 30)))
        off = p - self.labels[self.w_row[picked]]
        g_weights, g_bias = off @ mean / len(picked), off.mean()
        # Down to words, then to buckets: a word's share of its windows, and each bucket's of its words.
        share = np.bincount(back, np.repeat(off / self.w_size[picked], self.w_size[picked]), len(distinct)) / size
        hit, where = np.unique(buckets, return_inverse=True)
        g = np.bincount(where, np.repeat(share, size), len(hit))
        self.sq_vectors[hit] += g * g
        m.vectors[hit] -= (RATE * g / np.sqrt(self.sq_vectors[hit]))[:, None] * m.weights
        self.sq_weights += g_weights**2
        m.weights -= 0.1 * RATE * g_weights / np.sqrt(self.sq_weights)
        self.sq_bias += g_bias**2
        m.bias -= 0.1 * RATE * g_bias / np.sqrt(self.sq_bias)

    def fit(self) -> Model:
        random = np.random.default_rng(3)
        for epoch in range(EPOCHS):
            # At first every window counts as its text, then the worst one of each text.
            picked = self.worst() if epoch else np.arange(len(self.w_row))
            picked = random.permutation(picked)
            batch = BATCH if epoch else BATCH * 8
            for at in range(0, len(picked), batch):
                self.step(picked[at : at + batch])
        return self.model


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> tuple[np.ndarray | None, float, float]:
    """(logit of each bucket, bias, prior) from labelled rows; no buckets without both classes."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    of = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(of.values())
    if len(of) < 2:
        return None, 0.0, of.get(1, 0) / total if total else 0.0
    fit = known.join(rows.select("id").distinct(), "id", "left_semi")
    draw = F.xxhash64(F.lit("toxicity"), F.col("id").cast("string"))
    picked = fit.filter("y = 0").orderBy(draw, "id").limit(SAMPLE).union(fit.filter("y = 1").orderBy(draw, "id").limit(SAMPLE)).toArrow()
    chosen = docs.sparkSession.createDataFrame(picked)
    # At most 2 * SAMPLE ids are broadcast.
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy("id").toArrow()
    y = sample.column("y").to_numpy().astype(float)
    prior = of[1] / total
    if y.min(initial=1) == y.max(initial=0):
        return None, 0.0, prior
    model = Training(sample.column("text").to_pylist(), y).fit()
    seen = y.mean()
    shift = np.log(prior / (1 - prior)) - np.log(seen / (1 - seen))
    return model.bucket_logits(), float(model.bias + shift), prior


def score_texts(column, logits: np.ndarray, bias: float) -> np.ndarray:
    raw, offsets = text_buffers(column)
    out = np.full(len(column), bias)
    for at, to in row_chunks(offsets):
        hashes, counts = word_hashes(raw, offsets[at : to + 1])
        if not len(hashes):
            continue
        own, starts, ends, _ = word_spans(raw, offsets[at : to + 1])
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        buckets, sizes = word_buckets(own, starts[first], ends[first], hashes[first])
        word = _sums(logits[buckets].astype(float), sizes) / sizes
        run = np.concatenate([[0.0], np.cumsum(word[back])])
        start, size, row = windows(counts)
        value = (run[start + size] - run[start]) / size
        some = np.flatnonzero(counts)
        most = np.maximum.reduceat(value, np.searchsorted(row, some))
        out[at + some] = most + bias
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def score(
    docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; held_out: a function of the id column, true where a label may not be used."""
    train = labels.filter(~F.coalesce(held_out(F.col(id_col)), F.lit(True)))
    logits, bias, prior = learn(docs, train, id_col, text, label)
    shared = docs.sparkSession.sparkContext.broadcast((logits, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias = shared.value
        for batch in batches:
            value = np.full(len(batch), prior) if logits is None else score_texts(batch.column(1), logits, bias)
            yield pa.record_batch([batch.column(0), pa.array(value)], names=["id", "score"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    out = own.mapInArrow(run, f"id {kind}, score double")
    return out.select(
        F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def fold(key, parts: int, held: int):
    """Whether crc32 of the key as text leaves `held` modulo parts."""
    return F.crc32(key.cast("string").cast("binary")) % parts == held


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, labels, lambda key: fold(key, 4, 2))
