"""Benchmark decontamination: a broadcast hash set of the test items' word windows, met by every document's own windows.

The items' windows are made on the executors and dealt into blocks of at most BLOCK_BYTES, by hash; the number
of blocks follows the measured size of all windows, so what is broadcast at a time has a bound whatever the
benchmark's size. Documents pass each block once, in place: nothing of them is shuffled, and between two blocks
they are written to the shared folder, so that a lost executor costs one pass at most. A hash that is met is
verified word for word before it counts. Hits are kept as spans of words, which `remove_spans` cuts from the
texts and `remove_documents` turns into a decision on whole documents.

Defined results: null and empty texts have no words and no hits; an item without words has no window, one with
fewer words than a window is one window; items without an id mark words, but aren't counted or listed; repeated
items and rows are judged alike; an empty table of documents gives an empty table, one of items no hits. Columns
of the input stay as they are.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesift.llm.common import Scratch, table
from lakesift.llm.wordhash import mix, row_chunks, text_buffers, word_hashes, word_spans
from lakesift.llm.wordruns import plain, words_of

WINDOW = 10
BLOCK_BYTES = 32 << 20
FILTER_BITS = 22
HITS = "array<struct<first:long,past:long>>"
_ARROW_HITS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))


def _places(window: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, window, dtype=np.uint64) | np.uint64(1)


def window_hashes(words: np.ndarray, width: int, places: np.ndarray) -> np.ndarray:
    """The hash of every run of `width` words, given the words' hashes."""
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        out += words[k : k + len(out)] * places[k]
    return mix(out)


@dataclass(frozen=True)
class Block:
    """A part of the hash set: windows sorted by (width, hash), with their words and the items that hold them."""

    places: np.ndarray
    hashes: dict[int, np.ndarray]  # by width
    texts: dict[int, list[bytes]]
    items: dict[int, list[list[str]]]
    seen: dict[int, np.ndarray]  # by width: which leading bits some hash has


def make_block(rows: list[tuple[str, str | None]], window: int) -> Block:
    """rows: (window's words joined by blanks, item)."""
    places, by_text = _places(window), defaultdict(set)
    for text, item in rows:
        by_text[text.encode()].update([] if item is None else [item])
    hashes, texts, items, seen = {}, {}, {}, {}
    for width, own in itertools.groupby(sorted(by_text, key=lambda t: t.count(b" ")), key=lambda t: t.count(b" ") + 1):
        own = list(own)
        ends = np.cumsum([0, *map(len, own)])
        words, _ = word_hashes(np.frombuffer(b"".join(own), np.uint8), ends)
        found = window_hashes(words, width, places)[::width]
        order = np.argsort(found, kind="stable")
        hashes[width] = found[order]
        texts[width] = [own[k] for k in order]
        items[width] = [sorted(by_text[own[k]]) for k in order]
        seen[width] = np.zeros(1 << FILTER_BITS, bool)
        seen[width][(found >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Block(places, hashes, texts, items, seen)


def _candidates(block: Block, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of a window, place of the first equal hash of the block)."""
    own = window_hashes(words, width, block.places)
    at = np.flatnonzero(block.seen[width][(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    to = np.searchsorted(block.hashes[width], own[at])
    real = (to < len(block.hashes[width])) & (block.hashes[width][np.minimum(to, len(block.hashes[width]) - 1)] == own[at])
    return at[real], to[real]


def _meet(block: Block, raw: np.ndarray, limits: np.ndarray, old: list) -> tuple[np.ndarray, list, list[set[str]]]:
    """Words, hit spans and items of each text between limits. old: spans that other blocks have found, or None."""
    low = plain(raw[limits[0] : limits[-1]])
    rows = limits - limits[0]
    words, counts = word_hashes(low, rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    change = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    starts = ends = None
    for width in block.hashes:
        at, to = _candidates(block, words, width)
        owner = np.searchsorted(first, at, side="right") - 1
        inside = at + width <= first[owner + 1]
        if inside.any() and starts is None:
            _, starts, ends, _ = word_spans(low, rows)
        own, texts = block.hashes[width], block.texts[width]
        for i, k, row in zip(at[inside].tolist(), to[inside].tolist(), owner[inside].tolist(), strict=True):
            text = b" ".join(low[starts[i] : ends[i + width - 1]].tobytes().split())
            alike = itertools.takewhile(lambda m, k=k: own[m] == own[k], range(k, len(own)))
            if (m := next((m for m in alike if texts[m] == text), None)) is not None:
                change[i] += 1
                change[i + width] -= 1
                items[row].update(block.items[width][m])
    for row, spans in enumerate(old):
        for s in spans or ():
            change[first[row] + s["first"]] += 1
            change[first[row] + s["past"]] -= 1
    hit = np.cumsum(change[:-1]) > 0
    begin = hit & ~np.concatenate([[False], hit[:-1]])
    begin[first[:-1][(counts > 0)]] |= hit[first[:-1][counts > 0]]  # spans end with their text
    begins = np.flatnonzero(begin)
    out: list[list] = [[] for _ in counts]
    if len(begins):
        owner = np.searchsorted(first, begins, side="right") - 1
        stops = np.flatnonzero(np.concatenate([hit, [False]]) == False)  # noqa: E712
        pasts = np.minimum(stops[np.searchsorted(stops, begins)], first[owner + 1])
        for row, a, b in zip(owner.tolist(), (begins - first[owner]).tolist(), (pasts - first[owner]).tolist(), strict=True):
            out[row].append({"first": a, "past": b})
    return counts, out, [items.get(row, set()) for row in range(len(counts))]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            old, held = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            words, hits, items = [], [], []
            for at, to in row_chunks(offsets):
                n, found, named = _meet(block, raw, offsets[at : to + 1], old[at:to])
                words += n.tolist()
                hits += found
                items += [sorted(new.union(was or ())) for new, was in zip(named, held[at:to], strict=True)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(hits, _ARROW_HITS), pa.array(items, pa.list_(pa.string())), pa.array(words, pa.int64())],
                names=["row", "body", "hits", "items", "n_words"],
            )

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of((text or "").encode())
                own = {b" ".join(words[k : k + window]).decode() for k in range(max(1, len(words) - window + 1))} if words else set()
                yield pa.record_batch([pa.array(sorted(own), pa.string()), pa.array([item] * len(own), pa.string())], names=["window", "item"])

    return run


def blocks_of(items: DataFrame, scratch: Scratch, window: int, id_col: str, text: str, block_bytes: int) -> Iterator[Block]:
    """The hash set of all items' windows, a block of at most about block_bytes at a time; one block at least."""
    own = items.select(F.col(id_col).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    held = scratch.write(own.mapInArrow(_windows(window), "window string, item string").distinct(), "windows")
    size = held.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = held.filter(F.pmod(F.xxhash64("window", "item"), F.lit(n)) == k).toArrow()
        yield make_block(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), window)


def find(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text: str = "text", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(row, body, hits, items, n_words) of every document: row holds the columns of docs, body its text, hits the
    spans of its words that lie in windows of the items, items the ids of those."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    now = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("body"), F.lit(None).cast(HITS).alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    schema = T.StructType([*now.schema.fields, T.StructField("n_words", T.LongType())])
    for k, block in enumerate(blocks_of(items, scratch, window, id_col, item_text, block_bytes)):
        if k:
            now = scratch.write(now, "passed").drop("n_words")
        now = now.mapInArrow(_scan(spark.sparkContext.broadcast(block)), schema)
    return now


def n_hit() -> Column:
    """How many words lie in hit spans."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["past"] - s["first"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        texts = batch.column(1).to_pylist()
        for k, spans in enumerate(batch.column(2).to_pylist()):
            if spans:
                own, starts, ends, _ = word_spans(plain(raw[offsets[k] : offsets[k + 1]]), np.array([0, offsets[k + 1] - offsets[k]]))
                text, keep, at = raw[offsets[k] : offsets[k + 1]].tobytes(), [], 0
                for s in spans:
                    keep.append(text[at : starts[s["first"]]])
                    at = ends[s["past"] - 1]
                texts[k] = b"".join([*keep, text[at:]]).decode("utf-8", "replace")
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["row", "body"])


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with every hit span cut from its text; all rows and columns stay."""
    found = find(docs, items, text=text, **options).select("row", "body", "hits")
    cut = found.mapInArrow(_cut, T.StructType(found.schema.fields[:2]))
    return cut.select(*[(F.col("body") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def remove_documents(docs: DataFrame, items: DataFrame, max_hit_percent: float = 0.0, **options) -> DataFrame:
    """docs without those of which more than so many percent of the words are hit."""
    found = find(docs, items, **options).filter(n_hit() * 100 <= F.col("n_words") * max_hit_percent)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        named.alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


ORACLE_SQL = f"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
test AS (
  SELECT DISTINCT item, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS t, least(len(w), {WINDOW}) AS k
  FROM item, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) AS r(i) WHERE len(w) > 0),
own AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM doc, (SELECT DISTINCT k FROM test) AS ks, unnest(range(1, len(w) - k + 2)) AS r(i)),
met AS (SELECT rid, i, own.k, item FROM own JOIN test ON own.t = test.t AND own.k = test.k),
hit AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT DISTINCT rid, i, k FROM met), unnest(range(i, i + k)) AS r(j) GROUP BY rid),
named AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM met WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(named.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""
