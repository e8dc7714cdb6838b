"""Token counts by rank-synchronous array merging, for byte-level BPE with word ends.

The words of a batch of texts are laid out as one ragged numpy array of symbols. In each round every word applies
its own lowest-rank pair, everywhere it occurs and leftmost first, all words at once; a word leaves when no pair
of it has a rank, and its count is the symbols that are left. Counts of words are kept in a bounded table per
Python worker, so frequent words are merged once; the result does not depend on what the table holds.

Texts are whole: nothing is truncated or padded and no begin or end token is added. Strings of added tokens inside
a text count as one token each, as the library has it by default.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted alike; an empty table
gives an empty table. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import table
from lakesift.llm.wordhash import row_chunks, text_buffers

KEPT_WORDS = 400_000  # words a worker keeps the counts of
NONE = np.iinfo(np.int64).max


@dataclass
class WordBpe:
    """Merges as sorted pair keys with ranks and results; all bounded by the vocabulary."""

    first: np.ndarray  # symbol of a byte
    last: np.ndarray  # symbol of a byte that ends a word
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    n_symbols: int
    words: str
    specials: list[str]


def _byte_names() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def load(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
        raise ValueError(f"{path}: not a lower-casing word BPE")
    ids = model["vocab"]
    names = _byte_names()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    n = max(ids.values()) + 1
    keys = np.array([ids[a] * n + ids[b] for a, b in pairs], np.int64)
    made = np.array([ids[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    return WordBpe(
        np.array([ids[c] for c in names], np.int64), np.array([ids[c + end] for c in names], np.int64),
        keys[order], order.astype(np.int64), made[order], n, split, [t["content"] for t in spec["added_tokens"]],
    )


def merge_counts(words: list[bytes], bpe: WordBpe) -> np.ndarray:
    """Symbols that survive all merges, for each (non-empty) word."""
    lengths = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbols = bpe.first[raw]
    ends = np.cumsum(lengths) - 1
    symbols[ends] = bpe.last[raw[ends]]
    owner = np.repeat(np.arange(len(words)), lengths)
    counts = lengths.copy()
    while len(symbols) > 1:
        keys = symbols[:-1] * bpe.n_symbols + symbols[1:]
        at = np.searchsorted(bpe.keys, keys)
        at[at == len(bpe.keys)] = 0
        ranks = np.where((bpe.keys[at] == keys) & (owner[:-1] == owner[1:]), bpe.ranks[at], NONE)
        ranks = np.append(ranks, NONE)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = np.minimum.reduceat(ranks, starts)
        sizes = np.diff(np.append(starts, len(symbols)))
        going = np.repeat(least != NONE, sizes)
        if not going.any():
            break
        hit = (ranks == np.repeat(least, sizes)) & going
        # Overlapping hits are one symbol repeated: every second one of such a run merges, from the left.
        run = np.flatnonzero(hit)
        new = np.concatenate([[True], np.diff(run) != 1])
        place = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
        run = run[place % 2 == 0]
        symbols[run] = bpe.made[np.searchsorted(bpe.keys, keys[run])]
        keep = going
        keep[run + 1] = False
        symbols, owner = symbols[keep], owner[keep]
        here = np.bincount(owner, minlength=len(words))
        counts = np.where(here > 0, here, counts)
    return counts


class Counter:
    """Counts of texts, with a bounded table of word counts."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.known = bpe, {}
        self.words = regex.compile(bpe.words.replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("|".join(map(regex.escape, bpe.specials))) if bpe.specials else None

    def split(self, text: str) -> tuple[list[str], int]:
        """(words, added tokens) of a text."""
        parts, added = [text], 0
        if self.special is not None and "<" in text:
            parts = self.special.split(text)
            added = len(parts) - 1
        found: list[str] = []
        for part in parts:
            plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
            found += self.words.findall(plain.lower())
        return found, added

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        new = list(set(itertools.chain.from_iterable(w for w, _ in split)) - self.known.keys())
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known = {}
            new = list(set(itertools.chain.from_iterable(w for w, _ in split)))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, merge_counts([w.encode() for w in part], self.bpe).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, words)) + added for words, added in split]


_counters: dict[str, Counter] = {}


def _run(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _counters:
            _counters.clear()
            _counters[name] = Counter(shared.value)
        counter = _counters[name]
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            tokens: list[int] = []
            for at, to in row_chunks(offsets):
                limits = offsets[at : to + 1].tolist()
                tokens += counter.counts([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in itertools.pairwise(limits)])
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row; vocabulary is the tokenizer's .json file."""
    bpe = load(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(bpe)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    out = own.mapInArrow(_run(shared, vocabulary), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
