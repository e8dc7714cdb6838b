"""The prefix trie of conversations, as the Cartesian tree over the LCP array of the sorted conversations.

Conversations become sequences of turn digests and are sorted by key ranges into blocks; lcp[i] is the number of
turns that conversation i shares with the one before it. The nodes of the trie are the intervals between
nearest smaller values of that array. Each block finds the nearest smaller values of its own rows with one stack;
those beyond it are found by the blocks' minima (one number a block) and by each block's chain of prefix and
suffix minima, in joins. Rows with equal LCP in one interval are merged into one node, the depths between a
node and its parent are filled in, and sums over subtrees are sums over intervals: of stack entries within a
block, of chains and block totals beyond it.

A conversation is one row of 32 characters and a number a turn, a block holds about BLOCK_ROWS conversations, and
only a few numbers a block pass the driver. Conversations that end in one node are hashed in order as a stream of
blocks. Tables between the steps are written to the shared folder.

Defined results: null role and text count as empty, a null turn comes first, turns of equal number are ordered by
their digest, rows without a conv_id belong to no conversation; equal conversations are members of the same nodes; an
empty table has no node. Other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakesift.llm.common import Scratch, table, words_of
from lakesift.llm.ordering import sorted_blocks

BLOCK_ROWS = 1 << 16
DIGEST = 32  # characters of a turn's digest
FAR = 2**31 - 1
NONE_SHA = hashlib.sha256(b"").hexdigest()
NODE, PIECE, SUFFIX, PREFIX, ENDS, TOTAL = range(6)
_SORTED = "block int, pos long, conv long, size int, lcp int, words array<int>, seq string"
_FIELDS = [
    ("kind", "int", pa.int32()), ("conv", "long", pa.int64()), ("depth", "int", pa.int32()), ("parent", "long", pa.int64()),
    ("tl", "int", pa.int32()), ("tr", "int", pa.int32()), ("v", "int", pa.int32()), ("n", "long", pa.int64()),
    ("children", "long", pa.int64()), ("leaves", "long", pa.int64()), ("saved", "long", pa.int64()), ("text", "string", pa.string()),
    ("block", "int", pa.int32()), ("upper", "int", pa.int32()), ("pos", "long", pa.int64()), ("words", "array<int>", pa.list_(pa.int32())),
]
_BLOCK_OUT = ", ".join(f"{n} {t}" for n, t, _ in _FIELDS)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(n) for r in rows], t) for n, _, t in _FIELDS], names=[n for n, _, _ in _FIELDS])


def common_turns(a: str, b: str) -> int:
    """How many turns two sequences of digests begin with in common."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv, turns): the turns of each conversation in order, each with its digest and its number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), digest.alias("digest"), F.size(words_of(text)).alias("words"))
    own = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), turn.alias("t"))
    return own.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuild(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin with the first turns of their group's first one: crc32(conv) % most turns of it."""
    heads = turns.select(F.col("conv").alias("head"), F.slice("turns", 1, most - 1).alias("lent"))
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    joined = turns.join(heads, F.col("conv") - F.col("conv") % group == F.col("head"), "left")
    lent = F.when(F.col("lent").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("lent", F.lit(1), h))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv", F.concat(lent, own).alias("turns"))


def _lcps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The LCP of each row with the one before it in its block; sequences are kept where blocks may begin or end."""
    before = None
    for batch in batches:
        seqs = batch.column(3).to_pylist()
        if not seqs:
            continue
        lcps = []
        for seq in seqs:
            lcps.append(None if before is None else common_turns(before, seq))
            before = seq
        keep = [s if k in (0, len(seqs) - 1) else None for k, s in enumerate(seqs)]
        sizes = pa.array([len(s) // DIGEST for s in seqs], pa.int32())
        yield pa.record_batch(
            [batch.column(0), batch.column(1), batch.column(2), sizes, pa.array(lcps, pa.int32()), batch.column(4), pa.array(keep, pa.string())],
            names=["block", "pos", "conv", "size", "lcp", "words", "seq"],
        )


def _edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        yield pa.record_batch([batch.column(0), pa.array([common_turns(a, b) for a, b in both], pa.int32())], names=["block", "lcp"])


@dataclass(frozen=True)
class Blocks:
    """A few numbers a block, blocks without rows left out: the first row's place and LCP, the least LCP and id."""

    place: dict[int, int]  # number of a block among those with rows
    offset: np.ndarray
    first: np.ndarray
    least: np.ndarray  # -1 for the end of all rows, after the last block
    conv: np.ndarray

    def left(self, block: int, v: int) -> int:
        """The nearest block, from `block` back, with an LCP below v."""
        while self.least[block] >= v:
            block = self.back[block]
        return block

    def right(self, block: int, v: int) -> int:
        """The nearest block, from `block` on, with an LCP below v; their number if there is none."""
        while self.least[block] >= v:
            block = self.ahead[block]
        return block

    def __post_init__(self):
        n = len(self.least)
        back, ahead = [-1] * n, [n - 1] * n
        for k in range(1, n):
            j = k - 1
            while j > 0 and self.least[j] >= self.least[k]:
                j = back[j]
            back[k] = j
        for k in range(n - 2, -1, -1):
            j = k + 1
            while j < n - 1 and self.least[j] >= self.least[k]:
                j = ahead[j]
            ahead[k] = j
        object.__setattr__(self, "back", back)
        object.__setattr__(self, "ahead", ahead)


def blocks_of(rows: DataFrame) -> Blocks:
    stats = sorted(tuple(r) for r in rows.groupBy("block").agg(F.count("*"), F.min("lcp"), F.min("conv")).collect())
    numbers = [s[0] for s in stats]
    spark = rows.sparkSession
    after = spark.createDataFrame(list(zip(numbers, numbers[1:], strict=False)), "block int, next int")
    lasts = rows.filter("seq IS NOT NULL").groupBy("block").agg(F.max_by("seq", "pos").alias("a"))
    firsts = rows.filter("pos = 0").select(F.col("block").alias("next"), F.col("seq").alias("b"))
    pairs = lasts.join(F.broadcast(after), "block").join(firsts, "next").select("next", "a", "b")
    edges = {r["block"]: r["lcp"] for r in pairs.mapInArrow(_edge, "block int, lcp int").collect()}
    first = np.array([edges.get(b, -1) for b in numbers] + [-1], np.int64)
    inner = np.array([FAR if s[2] is None else s[2] for s in stats] + [FAR], np.int64)
    return Blocks(
        {b: k for k, b in enumerate(numbers)}, np.cumsum([0] + [s[1] for s in stats]), first, np.minimum(first, inner),
        np.array([s[3] for s in stats] + [2**63 - 1], np.int64),
    )


class _Entry:
    """An open node: its LCP, the last row with it, how many rows have it, and what its rows add up to.

    inner and inner_sums stand for the rows before `pos` that belong to it, least and sums for those from `pos` on."""

    __slots__ = ("count", "inner", "inner_sums", "least", "pos", "sums", "value", "waiting")

    def __init__(self, value: int, pos: int, inner: int, inner_sums: tuple[int, int], waiting: list):
        self.value, self.pos, self.count, self.inner, self.inner_sums = value, pos, 1, inner, inner_sums
        self.least, self.sums, self.waiting = 2**63 - 1, (0, 0), waiting


def _sum(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return a[0] + b[0], a[1] + b[1]


def _chain(conv: int, low: int, v: int, n: int, words: list[int], nested: tuple[int, int], children: int, sha: str) -> list[dict]:
    """The nodes of one interval, from depth v up to low + 1; the last one's parent is another interval."""
    saved, leaves = nested[0], nested[1] + (children == 0)
    out = []
    for d in range(v, low, -1):
        saved += (n - 1) * words[d - 1] if d else 0
        out.append({"kind": NODE, "conv": conv, "depth": d, "parent": conv, "n": n, "children": children if d == v else 1, "leaves": leaves, "saved": saved, "text": sha if d == v else NONE_SHA})
    out[-1]["parent"] = None
    return out


def _ids(convs: list[int]) -> str:
    return ",".join(map(str, convs))


def block_tree(b: int, conv: list[int], size: list[int], lcp: list[int], words: list[list[int]], blocks: Blocks) -> list[dict]:
    """The nodes that lie in one block, the pieces of those that don't, and its chains and totals."""
    m, then = len(conv), int(blocks.first[b + 1])
    out: list[dict] = []
    run = [1] * m
    for i in range(m - 2, -1, -1):
        if lcp[i + 1] == size[i + 1] == size[i]:
            run[i] += run[i + 1]
    ended = [False] * m
    ground = _Entry(-2, -1, 2**63 - 1, (0, 0), [])
    stack, prefix = [ground], FAR

    def ask(nodes: list[dict], tl: int, tr: int, v: int) -> None:
        """Nodes whose parent lies beyond the block; the root has none."""
        for node in nodes:
            out.append(node | {"tl": tl, "tr": tr, "v": v} if v >= 0 else node)

    for i in range(m + 1):
        now = lcp[i] if i < m else then
        carried: list[dict] = []
        if i:
            row, top = i - 1, stack[-1]
            low = max(lcp[row], now)
            if size[row] > low:
                ended[row] = True
                nodes = _chain(conv[row], low, size[row], 1, words[row], (0, 0), 0, hashlib.sha256(_ids([conv[row]]).encode()).hexdigest())
                out += nodes[:-1]
                (top.waiting if lcp[row] >= now else carried).append(nodes[-1])
                top.sums = _sum(top.sums, (0, 1))
        while stack[-1].value > now:
            node, below = stack.pop(), stack[-1]
            nested = _sum(node.inner_sums, node.sums)
            least = min(node.inner, node.least)
            below.least = min(below.least, least)
            if below is ground:
                tl, tr = blocks.left(b - 1, node.value), blocks.right(b, node.value)
                out.append({"kind": PIECE, "tl": tl, "tr": tr, "v": node.value, "n": node.count})
                ask(node.waiting, tl, tr, node.value)
                below.sums = nested
                continue
            at = below.pos
            ends = run[at] if size[at] == node.value else 0
            ended[at] |= ends > 0
            sha = hashlib.sha256(_ids(conv[at : at + ends]).encode()).hexdigest()
            nodes = _chain(least, max(below.value, now), node.value, i - at, words[at], nested, node.count - ends + 1, sha)
            for child in node.waiting:
                child["parent"] = least
            out += node.waiting
            out += nodes[:-1]
            (below.waiting if below.value >= now else carried).append(nodes[-1])
            below.sums = (nodes[-1]["saved"], nodes[-1]["leaves"])
        if i == m:
            ask(carried, blocks.left(b, then) if then >= 0 else 0, blocks.right(b + 1, then) if then >= 0 else 0, then)
            break
        top = stack[-1]
        if top.value == now:
            top.inner, top.inner_sums = min(top.inner, top.least), _sum(top.inner_sums, top.sums)
            top.pos, top.count, top.least, top.sums = i, top.count + 1, conv[i], (0, 0)
            top.waiting += carried
        else:
            if top is ground:
                out.append({"kind": PREFIX, "block": b, "v": now, "upper": prefix, "pos": i, "conv": ground.least, "saved": ground.sums[0], "leaves": ground.sums[1]})
                prefix = now
            stack.append(_Entry(now, i, top.least, top.sums, carried))
            stack[-1].least = conv[i]
    least, sums, upper = stack[-1].least, stack[-1].sums, FAR  # from a node's last row to the block's end
    for k in range(len(stack) - 1, 0, -1):
        node = stack[k]
        if k < len(stack) - 1:
            least, sums = min(least, stack[k + 1].inner), _sum(sums, stack[k + 1].inner_sums)
        out.append({"kind": SUFFIX, "block": b, "v": node.value, "upper": upper, "pos": node.pos, "conv": least, "saved": sums[0], "leaves": sums[1], "words": words[node.pos]})
        upper = node.value
        tl, tr = (blocks.left(b if k > 1 else b - 1, node.value), blocks.right(b + 1, node.value)) if node.value >= 0 else (0, 0)
        if node.value >= 0:
            out.append({"kind": PIECE, "tl": tl, "tr": tr, "v": node.value, "n": node.count})
        ask(node.waiting, tl, tr, node.value)
    total = _sum(sums, stack[1].inner_sums) if len(stack) > 1 else ground.sums
    at = 0
    while at < m:
        if not ended[at]:
            d, entered = size[at], at == 0 and lcp[0] == size[0]
            tl = blocks.left(b - 1 if entered else b, d)
            tr = blocks.right(b if entered else b + 1, d)
            out.append({"kind": ENDS, "tl": tl, "tr": tr, "v": d, "block": b, "n": run[at], "text": _ids(conv[at : at + run[at]])})
        at += run[at]
    out.append({"kind": TOTAL, "block": b, "saved": total[0], "leaves": total[1]})
    return out


def _trees(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, held, block = shared.value, [], None

        def close():
            lcp = [int(blocks.first[block]) if x is None else x for x in (r[2] for r in held)]
            rows = block_tree(block, [r[0] for r in held], [r[1] for r in held], lcp, [r[3] for r in held], blocks)
            for at in range(0, len(rows), 20_000):
                yield _batch(rows[at : at + 20_000])

        for batch in batches:
            own = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            for number, *row in own:
                if blocks.place[number] != block:
                    if held:
                        yield from close()
                    block, held = blocks.place[number], []
                held.append(row)
        if held:
            yield from close()

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for the ids of each key, whose parts come in order."""
    key, hashed, n, done = None, None, 0, []
    for batch in batches:
        for tl, tr, v, count, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if (tl, tr, v) != key:
                if key is not None:
                    done.append((*key, n, hashed.hexdigest()))
                key, hashed, n = (tl, tr, v), hashlib.sha256(), 0
            hashed.update((("," if n else "") + text).encode())
            n += count
    if key is not None:
        done.append((*key, n, hashed.hexdigest()))
    names, kinds = ["tl", "tr", "v", "ends", "sha"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    yield pa.record_batch([pa.array([d[k] for d in done], kinds[k]) for k in range(5)], names=names)


def _levels(values: np.ndarray) -> list[np.ndarray]:
    """Minima of runs of 1, 2, 4, ... values."""
    out = [values]
    while 2 ** len(out) <= len(values):
        step = 2 ** (len(out) - 1)
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
    return out


_CROSS = "tl int, tr int, v int, depth int, conv long, n long, children long, leaf long, weight long, saved long, leaves long, sha string, ptl int, ptr int, pv int"
_CROSS_COLUMNS = ["tl", "tr", "v", "count", "lv", "lpos", "lconv", "lsaved", "lleaves", "words", "rv", "rpos", "rconv", "rsaved", "rleaves", "ends", "sha"]


def _crossing(shared):
    """The nodes of intervals over several blocks, with what lies in them of nodes within one block."""
    kinds = [pa.int32()] * 4 + [pa.int64()] * 7 + [pa.string()] + [pa.int32()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, saved, leaves = shared.value
        levels = _levels(blocks.conv)
        for batch in batches:
            rows = []
            for tl, tr, v, count, lv, lpos, lconv, lsaved, lleaves, words, rv, rpos, rconv, rsaved, rleaves, ends, sha in zip(*(batch.column(c).to_pylist() for c in _CROSS_COLUMNS), strict=True):
                conv, low = min(lconv, rconv), max(lv, rv)
                if (width := tr - tl - 1) > 0:
                    level = width.bit_length() - 1
                    conv = min(conv, int(levels[level][tl + 1]), int(levels[level][tr - 2**level]))
                n = int(blocks.offset[tr] + rpos - blocks.offset[tl] - lpos)
                s, k = lsaved + rsaved + int(saved[tr] - saved[tl + 1]), lleaves + rleaves + int(leaves[tr] - leaves[tl + 1])
                children = count - (ends or 0) + 1
                for d in range(v, low, -1):
                    last = d == low + 1
                    parent = (blocks.left(tl, low), blocks.right(tr, low), low) if last and low >= 0 else (None, None, None)
                    weight = (n - 1) * words[d - 1] if d else 0
                    rows.append((tl, tr, v, d, conv, n, children if d == v else 1, int(d == v and children == 0), weight, s, k, sha if d == v and ends else NONE_SHA, *parent))
            yield pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(15)], names=[x.split()[0] for x in _CROSS.split(", ")])

    return run


def _before(rows: list, n: int, name: str) -> np.ndarray:
    """Sums over the blocks before each one."""
    own = np.zeros(n + 1, np.int64)
    for r in rows:
        own[r["block"] + 1] = r[name]
    return np.cumsum(own)


def trie(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a node of the trie of (conv, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    own = turns.select("conv", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = sorted_blocks(own, ["seq", "conv"], scratch, "sorted", block_rows, lambda df: df.select("block", "pos", "conv", "seq", "words").mapInArrow(_lcps, _SORTED))
    blocks = blocks_of(rows)
    n = len(blocks.place)
    shared = spark.sparkContext.broadcast(blocks)
    dealt = rows.select("block", "conv", "size", "lcp", "words", "pos").repartition("block").sortWithinPartitions("block", "pos").drop("pos")
    made = scratch.write(dealt.mapInArrow(_trees(shared), _BLOCK_OUT), "trees", ["kind"])

    def kind(k: int) -> DataFrame:
        return made.filter(F.col("kind") == k)

    totals = kind(TOTAL).select("block", "saved", "leaves").collect()
    sums = spark.sparkContext.broadcast((blocks, _before(totals, n, "saved"), _before(totals, n, "leaves")))
    pieces = kind(PIECE).groupBy("tl", "tr", "v").agg(F.sum("n").alias("count"))
    left = kind(SUFFIX).select(F.col("block").alias("tl"), F.col("v").alias("lv"), F.col("upper").alias("lupper"), F.col("pos").alias("lpos"), F.col("conv").alias("lconv"), F.col("saved").alias("lsaved"), F.col("leaves").alias("lleaves"), "words")
    end = spark.createDataFrame([(n, -1, FAR, 0, 2**63 - 1, 0, 0)], "tr int, rv int, rupper int, rpos long, rconv long, rsaved long, rleaves long")
    right = kind(PREFIX).select(F.col("block").alias("tr"), F.col("v").alias("rv"), F.col("upper").alias("rupper"), F.col("pos").alias("rpos"), F.col("conv").alias("rconv"), F.col("saved").alias("rsaved"), F.col("leaves").alias("rleaves")).union(end)
    ends = kind(ENDS).repartition("tl", "tr", "v").sortWithinPartitions("tl", "tr", "v", "block").select("tl", "tr", "v", "n", "text").mapInArrow(_streamed, "tl int, tr int, v int, ends long, sha string")
    found = pieces.join(left, (pieces["tl"] == left["tl"]) & (F.col("lv") < F.col("v")) & (F.col("v") <= F.col("lupper"))).drop(left["tl"])
    found = found.join(right, (found["tr"] == right["tr"]) & (F.col("rv") < F.col("v")) & (F.col("v") <= F.col("rupper"))).drop(right["tr"])
    found = found.join(ends, ["tl", "tr", "v"], "left").select(*_CROSS_COLUMNS)
    crossing = scratch.write(found.mapInArrow(_crossing(sums), _CROSS), "crossing")
    # Nodes that go beyond their first row's block lie on one path there, the deeper in the less deep.
    path = Window.partitionBy("tl").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    over = crossing.groupBy(F.col("tl").alias("block")).agg(F.sum("weight").alias("saved"), F.sum("leaf").alias("leaves")).collect()
    saved, leaves = _before(over, n, "saved").tolist(), _before(over, n, "leaves").tolist()
    before = spark.createDataFrame(list(zip(range(n + 1), saved, leaves, strict=True)), "b int, s long, l long")
    added = (
        crossing.withColumn("ps", F.sum("weight").over(path)).withColumn("pl", F.sum("leaf").over(path))
        .join(F.broadcast(before.toDF("tr", "rs", "rl")), "tr").join(F.broadcast(before.select((F.col("b") - 1).alias("tl"), F.col("s").alias("ls"), F.col("l").alias("ll"))), "tl")
        .withColumn("saved", F.col("saved") + F.col("ps") + F.col("rs") - F.col("ls")).withColumn("leaves", F.col("leaves") + F.col("pl") + F.col("rl") - F.col("ll"))
        .withColumn("parent", F.when(F.col("pv").isNull() & (F.col("depth") > 0), F.col("conv")))
    )
    columns = ["conv", "depth", "parent", "n", "children", "leaves", "saved", "sha", "ptl", "ptr", "pv"]
    inner = kind(NODE).select("conv", "depth", "parent", "n", "children", "leaves", "saved", F.col("text").alias("sha"), F.col("tl").alias("ptl"), F.col("tr").alias("ptr"), F.col("v").alias("pv"))
    nodes = inner.union(added.select(*columns))
    parents = crossing.filter("depth = v").select(F.col("tl").alias("ptl"), F.col("tr").alias("ptr"), F.col("v").alias("pv"), F.col("conv").alias("over"))
    open_ = nodes.filter("pv IS NOT NULL").join(parents, ["ptl", "ptr", "pv"]).withColumn("parent", F.col("over"))
    done = nodes.filter("pv IS NULL").select(*columns).union(open_.select(*columns))
    return done.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return trie(rebuild(sequences(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crcs),
turn AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % 20 AS head, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)),
    lambda c, x: xor(c // 256, crcs[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turn), crc_table),
rebuilt AS (
  SELECT c.conv_id, role, text, k, 0 AS own FROM conv c JOIN turn t ON t.conv_id = c.head AND t.k <= c.h
  UNION ALL SELECT c.conv_id, role, text, k, 1 AS own FROM conv c JOIN turn t ON t.conv_id = c.conv_id AND t.k > c.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS d FROM rebuilt),
prefix AS (
  SELECT conv_id, d, text, list(sha256(strlen(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY d) AS p, count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed),
member AS (
  SELECT conv_id, d, array_to_string(p, ',') AS node, array_to_string(p[:-2], ',') AS up, text, n = d AS ends FROM prefix
  UNION ALL SELECT conv_id, 0, 'root', NULL, '', NOT EXISTS (FROM placed WHERE placed.conv_id = conv.conv_id) FROM conv),
node AS (
  SELECT node, any_value(CASE WHEN d = 1 THEN 'root' ELSE up END) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(text) AS text,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM member GROUP BY node, d),
counted AS (
  SELECT *, (SELECT count(*) FROM node c WHERE c.up = node.node) AS n_children,
    (n_convs - 1) * len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS saved FROM node),
below AS (
  WITH RECURSIVE r(top, node, leaf, saved) AS (
    SELECT node, node, n_children = 0, saved FROM counted
    UNION ALL SELECT r.top, c.node, c.n_children = 0, c.saved FROM r JOIN counted c ON c.up = r.node)
  SELECT top, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM r GROUP BY top)
SELECT c.conv_id, c.d::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN below ON top = c.node LEFT JOIN node p ON p.node = c.up"""
