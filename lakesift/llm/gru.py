"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state.

Words are numbered by falling count; a class is a run of numbers, so P(word) = P(class | state) P(word | class, state)
costs about two square roots of the vocabulary. Everything is float32 and deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HIDDEN = 24
CLASSES = 48
SCORED = 1 << 15  # words whose probabilities are made together
WINDOW = 16  # steps that gradients go back
TOGETHER = 1 << 12  # of them that share the arrays of their classes
LONG_RUN = 24  # rows that are summed on their own


def class_limits(counts: np.ndarray) -> np.ndarray:
    """Limits of at most CLASSES runs of words with about equal sums of root counts."""
    mass = np.cumsum(np.sqrt(np.maximum(counts, 1.0)))
    cut = np.searchsorted(mass, mass[-1] * np.arange(1, CLASSES) / CLASSES) + 1
    return np.unique(np.concatenate([[0], cut, [len(counts)]])).astype(np.int64)


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights that give the words' own frequencies whatever the state."""
    random = np.random.default_rng(17)
    n, limits = len(counts), class_limits(counts)
    p = np.maximum(counts, 1.0) / np.maximum(counts, 1.0).sum()
    c = np.add.reduceat(p, limits[:-1])
    weights = {
        "x": random.normal(0, 0.3, (n, 3 * HIDDEN)), "u": random.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)),
        "wc": random.normal(0, 0.05, (HIDDEN, len(c))), "bc": np.log(c),
        "ww": random.normal(0, 0.05, (HIDDEN, n)), "bw": np.log(p) - np.log(np.repeat(c, np.diff(limits))),
    }
    return {k: v.astype(np.float32) for k, v in weights.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _gates(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """(x, u) by gates, so that what a step reads and makes of each gate lies together."""
    return tuple(np.ascontiguousarray(w[k].reshape(-1, 3, HIDDEN).transpose(1, 0, 2)) for k in "xu")


def run(w: dict, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False, gates: tuple | None = None) -> tuple[np.ndarray, list]:
    """States (steps, lanes, HIDDEN) that read ids; the state is 0 where fresh. keep: what backpropagation needs."""
    out, held = np.empty((*ids.shape, HIDDEN), np.float32), []
    xs, us = gates or _gates(w)
    for t in range(len(ids)):
        if fresh[t].any():
            h = np.where(fresh[t][:, None], np.float32(0), h)
        x, r = xs.take(ids[t], axis=1), h @ us
        x[:2] += r[:2]
        z, g = _sigmoid(x[:2])
        new = x[2]
        new += g * r[2]
        np.tanh(new, out=new)
        if keep:
            held.append((h, z, g, new, r[2]))
        h = h - new
        h *= z
        h += new
        out[t] = h
    return out, held


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place: sums along columns are made of whole rows, which costs less than row by row."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One entry of each column's logarithms; x is used up."""
    x -= x.max(axis=0)
    own = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    return own - np.log(x.sum(axis=0))


def _logits(weights: np.ndarray, bias: np.ndarray, states: np.ndarray) -> np.ndarray:
    """(entries, states)."""
    out = weights.T @ states.T
    out += bias[:, None]
    return out


def _by_class(limits: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the words by class, their classes in this order, where each class begins and ends in it)."""
    of = np.repeat(np.arange(len(limits) - 1, dtype=np.int16), np.diff(limits))[words]  # 16 bits are sorted by radix
    order = np.argsort(of, kind="stable")
    of = of[order]
    return order, of, np.searchsorted(of, np.arange(len(limits)))


def log_probabilities(w: dict, limits: np.ndarray, states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each word after its state."""
    order, of, at = _by_class(limits, words)
    states, words = states[order], words[order]
    own = np.empty(len(words), np.float32)
    for i in range(0, len(words), TOGETHER):
        part = slice(i, i + TOGETHER)
        own[part] = _log_softmax_at(_logits(w["wc"], w["bc"], states[part]), of[part])
    for c in range(len(limits) - 1):
        a, b, rows = limits[c], limits[c + 1], slice(at[c], at[c + 1])
        if b - a > 1 and at[c + 1] > at[c]:
            own[rows] += _log_softmax_at(_logits(w["ww"][:, a:b], w["bw"][a:b], states[rows]), words[rows] - a)
    out = np.empty_like(own)
    out[order] = own
    return out


def _run_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each run of rows; long runs one by one, the others all together, a row of each at a time."""
    n = np.diff(np.append(starts, len(rows)))
    out = rows.take(starts, axis=0)
    for i in np.flatnonzero(n > LONG_RUN):
        out[i] = rows[starts[i] : starts[i] + n[i]].sum(axis=0)
    some = np.flatnonzero((n > 1) & (n <= LONG_RUN))
    some = some[np.argsort(-n[some], kind="stable")]
    for k in range(1, int(n[some].max(initial=1))):
        more = some[: np.searchsorted(-n[some], -k)]
        out[more] += rows.take(starts[more] + k, axis=0)
    return out


def gradients(w: dict, limits: np.ndarray, ids: np.ndarray, fresh: np.ndarray, words: np.ndarray, use: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
    """(gradients of the mean loss over the steps in use, last state)."""
    g, hit, sums, last = _gradients(w, limits, ids, fresh, words, use, h)
    g["x"] = np.zeros_like(w["x"])
    g["x"][hit] = sums
    return g, last


def _gradients(w: dict, limits: np.ndarray, ids: np.ndarray, fresh: np.ndarray, words: np.ndarray, use: np.ndarray, h: np.ndarray) -> tuple:
    """(gradients of all weights but `x`, the rows of `x` that were read, their gradients, last state)."""
    steps, lanes = ids.shape
    states, held = run(w, ids, fresh, h, keep=True)
    order, of, at = _by_class(limits, words.ravel())
    flat, y = states.reshape(-1, HIDDEN).take(order, axis=0), words.ravel()[order]
    scale = (use.ravel()[order] / max(1, use.sum())).astype(np.float32)
    d = _softmax(_logits(w["wc"], w["bc"], flat))
    d[of, np.arange(len(y))] -= 1
    d *= scale
    g = {k: np.zeros_like(v) for k, v in w.items() if k != "x"}
    g["wc"], g["bc"] = (d @ flat).T, d.sum(axis=1)
    sent = d.T @ w["wc"].T
    for c in range(len(limits) - 1):
        a, b, rows = limits[c], limits[c + 1], slice(at[c], at[c + 1])
        if b - a > 1 and at[c + 1] > at[c]:
            own = _softmax(_logits(w["ww"][:, a:b], w["bw"][a:b], flat[rows]))
            own[y[rows] - a, np.arange(own.shape[1])] -= 1
            own *= scale[rows]
            g["ww"][:, a:b], g["bw"][a:b] = (own @ flat[rows]).T, own.sum(axis=1)
            sent[rows] += own.T @ w["ww"][:, a:b].T
    back = np.empty_like(sent)
    back[order] = sent
    back = back.reshape(steps, lanes, HIDDEN)
    dh = np.zeros((lanes, HIDDEN), np.float32)
    k = HIDDEN
    dx, du = (np.empty((steps, lanes, 3 * k), np.float32) for _ in range(2))
    for t in range(steps - 1, -1, -1):
        before, z, gate, new, rn = held[t]
        dh = dh + back[t]
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (before - new) * z * (1 - z)
        dr = dn * rn * gate * (1 - gate)
        dx[t, :, :k], dx[t, :, k : 2 * k], dx[t, :, 2 * k :] = dz, dr, dn
        du[t], du[t, :, 2 * k :] = dx[t], dn * gate
        dh = dh * z + du[t] @ w["u"].T
        if fresh[t].any():
            dh = np.where(fresh[t][:, None], np.float32(0), dh)
    g["u"] = np.concatenate([h[0] for h in held]).T @ du.reshape(-1, 3 * k)
    read = ids.ravel().astype(np.uint16 if len(w["x"]) <= 1 << 16 else np.int64)
    by = np.argsort(read, kind="stable")
    starts = np.flatnonzero(np.diff(read[by], prepend=read[by[:1]] + 1))
    hit, sums = read[by[starts]].astype(np.int64), _run_sums(dx.reshape(-1, 3 * HIDDEN).take(by, axis=0), starts)
    return g, hit, sums, states[-1]


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Rows dealt to lanes of about equal length, longest rows first; longest lanes first."""
    import heapq

    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    total = [0] * len(heap)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        out[k].append(i)
        total[k] = n + int(lengths[i])
        heapq.heappush(heap, (total[k], k))
    return [out[k] for k in sorted(range(len(out)), key=lambda k: -total[k])]


def streams(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lanes: int, end: int, warm: np.ndarray | None = None) -> Iterator[tuple]:
    """Windows over all rows, dealt to lanes: (inputs, fresh, words, place of each word, in use); lanes end one by one.

    A row's first word follows `end` and a fresh state. A row with warm > 0 goes on from an earlier one: its first word
    follows the word before it, and its first `warm` words are read for the state alone."""
    dealt = lanes_of(lengths, lanes)
    if not dealt:
        return
    total = np.array([int(lengths[rows].sum()) for rows in dealt])
    places = np.full((len(dealt), -(-int(total[0]) // WINDOW) * WINDOW), -1, np.int32 if len(words) < 1 << 31 else np.int64)
    first, begins, counts = np.zeros(places.shape, bool), np.zeros(places.shape, bool), np.ones(places.shape, bool)
    for k, rows in enumerate(dealt):
        own = np.array(rows)
        n = lengths[own]
        at = np.cumsum(n) - n
        places[k, : total[k]] = np.repeat(starts[own] - at, n) + np.arange(total[k])
        first[k, at] = True
        if warm is not None:
            begins[k, at[warm[own] == 0]] = True
            counts[k, : total[k]] = np.arange(total[k]) - np.repeat(at, n) >= np.repeat(warm[own], n)
    begins = first if warm is None else begins
    for t in range(0, places.shape[1], WINDOW):
        live = int((total > t).sum())
        at, new, begin, own = (x[:live, t : t + WINDOW].T for x in (places, first, begins, counts))
        there = at >= 0
        inputs = np.where(begin | ~there, end, words[np.maximum(at - 1, 0)])
        yield inputs, new, np.where(there, words[np.maximum(at, 0)], end), at, there & own


class Trainer:
    """Adam over windows. Its averages, step and rate plan last over all rows that it is given, in any number of parts;
    the rate falls from `rate` to `last` over `planned` words. Rows of `x` move in the windows that read them."""

    def __init__(self, w: dict, limits: np.ndarray, end: int, rate: float, last: float, planned: float, lanes: int):
        self.w = {k: v.copy() for k, v in w.items()}
        self.one, self.two = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        self.limits, self.end, self.rate, self.last, self.planned, self.lanes = limits, end, rate, last, max(planned, 1.0), lanes
        self.step, self.seen = 0, 0

    def learn(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, warm: np.ndarray | None = None) -> None:
        h = np.zeros((self.lanes, HIDDEN), np.float32)
        for inputs, fresh, y, _, use in streams(words, starts, lengths, self.lanes, self.end, warm):
            g, hit, sums, h = _gradients(self.w, self.limits, inputs, fresh, y, use, h[: inputs.shape[1]])
            self.step += 1
            self.seen += int(use.sum())
            now = self.rate + (self.last - self.rate) * min(1.0, self.seen / self.planned)
            size = np.sqrt(sum(float((v * v).sum()) for v in (*g.values(), sums)))
            clip = np.float32(min(1.0, 1.0 / (size + 1e-12)))
            a, b = 1 - 0.9**self.step, 1 - 0.99**self.step
            for k, v in (*g.items(), ("x", sums)):
                v *= clip
                one, two = (m[k].take(hit, axis=0) if k == "x" else m[k] for m in (self.one, self.two))
                one += np.float32(0.1) * (v - one)
                v *= v
                v -= two
                v *= np.float32(0.01)
                two += v
                np.divide(two, np.float32(b), out=v)
                np.sqrt(v, out=v)
                v += np.float32(1e-8)
                np.divide(one, v, out=v)
                v *= np.float32(now / a)
                if k == "x":
                    self.one[k][hit], self.two[k][hit] = one, two
                    self.w[k][hit] -= v
                else:
                    self.w[k] -= v


def train(w: dict, limits: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, end: int, rate: float, lanes: int, epochs: int = 1) -> dict:
    """Adam over all windows of all rows."""
    trainer = Trainer(w, limits, end, rate, rate / 10, float(lengths.sum()) * epochs, lanes)
    for _ in range(epochs):
        trainer.learn(words, starts, lengths)
    return trainer.w


def score_rows(w: dict, limits: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, end: int, lanes: int) -> np.ndarray:
    """Natural log of the probability of every row, its state carried through all windows."""
    each = np.zeros(len(words), np.float64)
    h = np.zeros((lanes, HIDDEN), np.float32)
    held: list[tuple] = []

    def flush() -> None:
        states, y, at = (np.concatenate(x) for x in zip(*held, strict=True))
        each[at] = log_probabilities(w, limits, states, y)
        held.clear()

    gates = _gates(w)
    for inputs, fresh, y, at, use in streams(words, starts, lengths, lanes, end):
        states, _ = run(w, inputs, fresh, h[: inputs.shape[1]], gates=gates)
        h = states[-1]
        held.append((states[use], y[use], at[use]))
        if sum(len(x[1]) for x in held) >= SCORED:
            flush()
    if held:
        flush()
    sums = np.concatenate([[0.0], np.cumsum(each)])
    return sums[starts + lengths] - sums[starts]
