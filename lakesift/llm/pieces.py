"""SentencePiece encoding and decoding by a batched numpy Viterbi, for BPE models with byte fallback.

Blanks become U+2581 and one goes before the text; no piece holds a blank after another character, so a text is
encoded word by word, distinct words once; long words are cut first where no piece holds the two characters side by
side, which no merge can cross. Words of equal length advance together, one character a step: the hashes of substrings
probe the sorted keys of pieces and of their beginnings, and a start that begins no piece any more is left. Of the
pieces that end at a step and may follow the piece at their start the maximum wins and is the backpointer. A model of merges has no additive score whose best path is its own
encoding (the sum of piece scores gives other pieces than the library), so a path's score here is minus infinity
unless each two neighbours are what the merges make of their joint text; then one path is left for each prefix. That
neighbour test undoes the merges of both pieces in turn and looks for a merge across the gap that comes first; its
answers are kept in a bounded table per Python worker.

Characters that are no piece become their UTF-8 bytes. Runs of blanks before a word merge last and from the left.
Decoding joins the pieces' bytes and drops the blank that was put first.

Defined results: a null or empty text has no tokens and decodes to an empty text; U+2581 in a text is a blank;
repeated rows are encoded alike; an empty table gives an empty table. Texts are whole. Only the id and text columns
are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import table
from lakesift.llm.wordhash import row_chunks, text_buffers

BLANK = "▁"
KEPT_WORDS = 1_000_000  # words a worker keeps the pieces of
PAIR_SLOTS = 1 << 20  # answers of the neighbour test that a worker keeps
LONG_WORD = 24  # characters from which a word is cut where it can be
SIEVE_BITS = 20
FAR = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


@dataclass
class Pieces:
    """A model as arrays; `rank` numbers the pieces in the order in which merges make them, characters first."""

    keys: np.ndarray  # sorted hashes of all pieces that merges can make
    key_rank: np.ndarray
    key_size: np.ndarray
    ids: np.ndarray  # by rank; -1: a character that is no piece
    size: np.ndarray  # in characters, by rank
    hashes: np.ndarray  # by rank
    left: np.ndarray  # by rank; itself for characters
    right: np.ndarray
    begin_keys: np.ndarray  # sorted hashes of all beginnings of pieces, whole ones too
    begin_rank: np.ndarray  # of the piece, -1: a beginning alone
    begin_sieve: np.ndarray  # by the first bits of a hash: whether any beginning has them
    joined: np.ndarray  # sorted codes of two characters that stand side by side in a piece
    longest: int
    runs: dict[int, int]  # id of a run of so many blanks
    byte_ids: np.ndarray
    raw: np.ndarray  # bytes of all pieces by id, one after the other
    raw_at: np.ndarray


def _hash(codes: list[int]) -> int:
    h = 0
    for c in codes:
        h = (h * int(_BASE) + c + 1) & (2**64 - 1)
    return h


def _last_merge(text: str, score: dict[str, float]) -> tuple[str, str] | None:
    """The two parts that the last merge of a piece's own text joins; None if merges end elsewhere."""
    parts = list(text)
    while len(parts) > 2:
        best = max(range(len(parts) - 1), key=lambda i: (score.get(parts[i] + parts[i + 1], -np.inf), -i))
        if parts[best] + parts[best + 1] not in score:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    if any(BLANK in texts[i].lstrip(BLANK) or texts[i].startswith(BLANK * 2) and texts[i].strip(BLANK) for i in plain):
        raise ValueError(f"{path}: a piece holds a blank after another character")
    run_ids = {len(texts[i]): i for i in plain if not texts[i].strip(BLANK)}
    if 1 not in run_ids:
        raise ValueError(f"{path}: a blank is no piece")
    id_of = {texts[i]: i for i in plain if texts[i].strip(BLANK) or texts[i] == BLANK}
    score = {t: model.get_score(i) for t, i in id_of.items()}
    merged = sorted((t for t in id_of if len(t) > 1), key=lambda t: -score[t])
    splits = {t: s for t in merged if (s := _last_merge(t, score))}
    letters = sorted({c for t in id_of for c in t})
    order = letters + [t for t in merged if t in splits]
    rank = {t: r for r, t in enumerate(order)}
    hashes = np.array([_hash([ord(c) for c in t]) for t in order], np.uint64)
    by_key = np.argsort(hashes, kind="stable")
    begins = {t[:k]: -1 for t in order for k in range(1, len(t))} | rank
    begin_hash = np.array([_hash([ord(c) for c in t]) for t in begins], np.uint64)
    by_begin = np.argsort(begin_hash, kind="stable")
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[(begin_hash >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
    joined = np.array(sorted({ord(a) << 21 | ord(b) for t in order for a, b in itertools.pairwise(t)}), np.int64)
    size = np.array([len(t) for t in order], np.int64)
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    parts = [t.replace(BLANK, " ").encode() for t in texts]
    for b, i in enumerate(byte_ids.tolist()):
        parts[i] = bytes([b])
    return Pieces(
        hashes[by_key], by_key.astype(np.int64), size[by_key], np.array([id_of.get(t, -1) for t in order], np.int64), size, hashes,
        np.array([rank[splits[t][0]] if t in splits else rank[t] for t in order], np.int64),
        np.array([rank[splits[t][1]] if t in splits else rank[t] for t in order], np.int64),
        begin_hash[by_begin], np.array(list(begins.values()), np.int64)[by_begin], sieve, joined,
        int(size.max()), run_ids, byte_ids,
        np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]),
    )


class Encoder:
    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(pieces.longest + 1, _BASE)]))
        self.pair_keys = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, bool)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)

    def _find(self, h: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Rank of the piece with that hash and size, -1 if there is none."""
        at = np.searchsorted(self.p.keys, h)
        at[at == len(self.p.keys)] = 0
        return np.where((self.p.keys[at] == h) & (self.p.key_size[at] == size), self.p.key_rank[at], -1)

    def _stands(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merges leave the two pieces apart."""
        p, ok = self.p, np.ones(len(one), bool)
        left, right, limit, live = one.copy(), two.copy(), np.full(len(one), FAR), np.arange(len(one))
        while len(live):
            a, b, cap = left[live], right[live], limit[live]
            size = p.size[a] + p.size[b]
            fits = size <= p.longest
            joint = np.full(len(live), -1, np.int64)
            h = p.hashes[a[fits]] * self.power[p.size[b[fits]]] + p.hashes[b[fits]]
            joint[fits] = self._find(h, size[fits])
            bad = (joint >= 0) & (joint < cap)
            ok[live[bad]] = False
            over = a > b
            na, nb = np.where(over, p.right[a], a), np.where(over, b, p.left[b])
            ncap = np.where(over, a, b + 1)
            stuck = np.where(over, na == a, nb == b)
            # The larger piece is a character: undo the other one.
            na2, nb2 = np.where(over, na, p.right[a]), np.where(over, p.left[b], nb)
            done = stuck & np.where(over, nb2 == b, na2 == a)
            ncap = np.where(stuck, np.where(over, b + 1, a), ncap)
            left[live], right[live] = np.where(stuck, na2, na), np.where(stuck, nb2, nb)
            limit[live] = ncap
            live = live[~(bad | done)]
        return ok

    def _may_follow(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        pair = one * np.int64(len(self.p.ids)) + two
        slot = ((pair.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64) % PAIR_SLOTS
        miss = np.flatnonzero(self.pair_keys[slot] != pair)
        ok = self.pair_ok[slot]
        if len(miss):
            new, back = np.unique(pair[miss], return_inverse=True)
            answer = self._stands(new // len(self.p.ids), new % len(self.p.ids))
            ok[miss] = answer[back]
            self.pair_keys[slot[miss]], self.pair_ok[slot[miss]] = pair[miss], ok[miss]
        return ok

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of words of equal length, tokens of each)."""
        p, n, length = self.p, len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length).T.astype(np.uint64)
        run = np.zeros((length + 1, n), np.uint64)
        for i in range(1, length + 1):
            run[i] = run[i - 1] * _BASE + codes[i - 1] + np.uint64(1)
        flat = run.ravel()
        # Of each size the (end, word) places and pieces, in order of ends.
        ending: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.arange(length * n)  # start * n + word
        for size in range(1, min(length, p.longest) + 1):
            live = live[: np.searchsorted(live, (length - size + 1) * n)]
            h = flat[live + size * n] - flat[live] * self.power[size]
            some = np.flatnonzero(p.begin_sieve[(h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
            h = h[some]
            at = np.searchsorted(p.begin_keys, h)
            at[at == len(p.begin_keys)] = 0
            hit = np.flatnonzero(p.begin_keys[at] == h)
            live, piece = live[some[hit]], p.begin_rank[at[hit]]
            made = np.flatnonzero(piece >= 0)
            if len(made):
                end = live[made] // n + size
                ending.append((size, live[made] % n, piece[made], np.searchsorted(end, np.arange(length + 2))))
            if not len(live):
                break
        last = np.full((length + 1, n), -1, np.int64)  # rank of the piece that ends here; -2: a character that is none
        back = np.ones((length + 1, n), np.int64)
        for i in range(1, length + 1):
            last[i] = -2
            for size, word, piece, limits in ending:  # larger sizes come later and win
                a, b = limits[i], limits[i + 1]
                if a == b:
                    continue
                at, own = word[a:b], piece[a:b]
                before = last[i - size][at]
                ok = before < 0
                held = np.flatnonzero(~ok)
                ok[held] = self._may_follow(before[held], own[held])
                at = at[ok]
                last[i, at], back[i, at] = own[ok], size
        # Backwards along the pointers, all words at once; characters that are no piece are marked.
        taken = np.full((n, length), -1, np.int64)
        where = np.full(n, length)
        rows = np.arange(n)
        while len(rows):
            at = where[rows]
            taken[rows, at - 1] = last[at, rows]
            where[rows] = at - back[at, rows]
            rows = rows[where[rows] > 0]
        word, end = np.nonzero(taken != -1)
        ranks = taken[word, end]
        ids = np.where(ranks >= 0, p.ids[ranks], -1).astype(np.int32)
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, np.bincount(word, minlength=n)
        # Characters that are no piece become their bytes.
        letters, kind = np.unique(codes[end[bare], word[bare]], return_inverse=True)
        raw = [np.frombuffer(chr(c).encode(), np.uint8) for c in letters.tolist()]
        times = np.ones(len(ids), np.int64)
        times[bare] = np.array([len(r) for r in raw])[kind]
        out, first = np.repeat(ids, times), np.cumsum(times) - times
        for at in range(4):
            more = np.flatnonzero(times[bare] > at)
            out[first[bare[more]] + at] = p.byte_ids[np.array([r[at] if len(r) > at else 0 for r in raw])[kind[more]]]
        return out, np.bincount(word, times, n).astype(np.int64)

    def _blanks(self, n: int) -> list[int]:
        out = []
        for size in sorted(self.p.runs, reverse=True):
            out += [self.p.runs[size]] * (n // size)
            n %= size
        return out

    def _cut(self, word: str) -> list[str]:
        """A long word's parts between characters that no piece holds side by side."""
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        pair = codes[:-1] << 21 | codes[1:]
        at = np.searchsorted(self.p.joined, pair)
        at[at == len(self.p.joined)] = 0
        limits = [0, *(np.flatnonzero(self.p.joined[at] != pair) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in itertools.pairwise(limits)]

    def _learn(self, units: list[str]) -> None:
        """Encodes words that aren't known yet; a unit is a run of blanks and a word."""
        bare = {u: (BLANK + w if len(w) < len(u) else w) for u in units if (w := u.lstrip(BLANK))}
        cut = {w: self._cut(w) for w in set(bare.values()) if len(w) >= LONG_WORD}
        by_length: dict[int, list[str]] = {}
        for w in {*(w for w in bare.values() if len(w) < LONG_WORD), *itertools.chain.from_iterable(cut.values())}:
            by_length.setdefault(len(w), []).append(w)
        place: dict[str, int] = {}
        found, many = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for length, words in by_length.items():
            most = max(1, 2_000_000 // length)
            for at in range(0, len(words), most):
                part = words[at : at + most]
                place.update(zip(part, range(len(place), len(place) + len(part)), strict=True))
                ids, counts = self.viterbi(part)
                found.append(ids)
                many.append(counts)
        pool, n = np.concatenate(found), np.concatenate(many)
        first = np.cumsum(n) - n

        def of(word: str) -> np.ndarray:
            if word in cut:
                return np.concatenate([of_part(part) for part in cut[word]])
            return of_part(word)

        def of_part(word: str) -> np.ndarray:
            k = place[word]
            return pool[first[k] : first[k] + n[k]]

        plain = [u for u in units if u in place]
        index = np.fromiter(map(place.__getitem__, plain), np.int64, len(plain))
        sizes = n[index]
        new = [pool[np.repeat(first[index] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]]
        others = [u for u in units if u not in place]
        for u in others:
            w = bare.get(u)
            if w is None:
                ids = np.array(self._blanks(len(u)), np.int32)
            else:
                ids, extra = of(w), len(u) - len(w)
                if extra and ids[0] == self.p.runs[1]:
                    ids = np.concatenate([np.array(self._blanks(extra + 1), np.int32), ids[1:]])
                elif extra:
                    ids = np.concatenate([np.array(self._blanks(extra), np.int32), ids])
            new.append(ids)
        self.known.update(zip([*plain, *others], range(len(self.sizes), len(self.sizes) + len(units)), strict=True))
        self.flat = np.concatenate([self.flat, *new])
        self.sizes = np.concatenate([self.sizes, sizes, [len(ids) for ids in new[1:]]]).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, tokens of each)."""
        split = [UNITS.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        words = list(itertools.chain.from_iterable(split))
        new = set(words) - self.known.keys()
        if len(self.known) + len(new) > KEPT_WORDS:
            self.forget()
            new = set(words)
        self._learn(list(new))
        sizes = self.sizes
        starts = np.concatenate([[0], np.cumsum(sizes)])
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        own = sizes[index]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts[index] - (ends - own), own) + np.arange(total)
        per_text = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        until = np.concatenate([[0], ends])[per_text]
        return self.flat[at], np.diff(until)


def decode_ids(ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bytes of each) from their tokens."""
    ids = ids.astype(np.int64)
    own = pieces.raw_at[ids + 1] - pieces.raw_at[ids]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(pieces.raw_at[ids] - (ends - own), own) + np.arange(total)
    until = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    keep = np.ones(total, bool)
    keep[until[:-1][counts > 0]] = False  # the blank that was put first
    return pieces.raw[at][keep], np.diff(until) - (counts > 0)


_encoders: dict[str, Encoder] = {}


def _encoded(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(shared.value)
        encoder = _encoders[name]
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for at, to in row_chunks(offsets):
                limits = offsets[at : to + 1].tolist()
                texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in itertools.pairwise(limits)]
                ids, counts = encoder.encode(texts)
                back, sizes = decode_ids(ids, counts, encoder.p)
                same, first = [], 0
                data = back.tobytes()
                for t, n in zip(texts, sizes.tolist(), strict=True):
                    same.append(data[first : first + n] == t.replace(BLANK, " ").encode())
                    first += n
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                yield pa.record_batch(
                    [batch.column(0).slice(at, to - at), pa.array(counts, pa.int64()), tokens, pa.array(same, pa.bool_())],
                    names=["id", "n_tokens", "tokens", "round_trip"],
                )

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_tokens, tokens, round_trip) of every row; round_trip: the decoded tokens are the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    out = own.mapInArrow(_encoded(shared, model), "id long, n_tokens long, tokens array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            counts = np.array([len(x) if x is not None else 0 for x in lists], np.int64)
            data, sizes = decode_ids(ids, counts, shared.value)
            limits = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(limits)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(id_col, text) of token lists; a null list is an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))
    own = encoded.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(tokens), F.array().cast("array<int>")).alias("tokens"))
    return own.mapInArrow(_decoded(shared), "id long, text string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
