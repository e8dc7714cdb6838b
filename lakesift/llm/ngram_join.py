"""N-gram Jaccard join over a token-group matrix.

A document is the set of its distinct word shingles; two documents link when
100 * |intersection| >= percent * |union|. The result is exact: no link between different texts is missed.

1. Exact copies share a fingerprint of the set; one representative goes on.
2. Each representative's tokens are put in one global order, rare ones first (by a frequency sketch of fixed
   size, then by hash). With n tokens, two linked sets share at least l tokens among the first
   n - ceil(percent% of n) + l of each, for any order and any l: that is the index.
   Two sets of sizes n and m that link share o = ceil(percent (n + m) / (100 + percent)) tokens, so l of them lie
   among the first n - o + l of the one and m - o + l of the other: later places of either don't count.
3. Similar documents are partitioned into groups: in STAR_ROUNDS rounds each index token names one of its holders,
   documents of other groups that share enough with that holder are verified against it, and verified stars form
   groups.
4. Pairs of different groups meet in the token-group matrix: the index tokens that several groups hold, in one order by
   their number of holders. Two documents that share l of them share one that is none of the l - 1 most held of
   either, for whatever the pair, its least held shared token has the other l - 1 before it in both. Those tokens,
   which all of a family hold, form no pairs. Pairs that meet must show l index tokens at places that count, and
   are then verified. Pairs inside one group are linked already and never expanded, so a group of near copies
   costs its size, not its square.
5. Union-find over all links.

Defined results: null, empty and blank texts have no shingles and link with nothing, not even each other;
repeated doc_ids form one node with the union of their links; rows without a doc_id keep their size, link with
nothing and have a null component; equal texts of rows with ids always link; an empty table gives an empty table.
Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import Scratch, growing, table
from lakesift.llm.components import roots
from lakesift.llm.wordhash import mix, shingle_sets, text_buffers

SKETCH_BITS = 22  # of the frequency sketch: counters a task holds
SKETCH_ROWS = 1 << 18  # frequent counters that are broadcast at most: 4 MB
STAR_ROUNDS = 2


def _needed(n, percent: int):
    return -(-n * percent // 100)


def _spare(n):
    """l: shared index tokens that a pair must show, by size of its smaller set."""
    return np.clip(n // 30, 1, 16) if isinstance(n, np.ndarray) else F.least(F.lit(16), F.greatest(F.lit(1), F.floor(n / 30)))


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _facts(width: int):
    """Per document: size and fingerprint. Per task: the counters that stand out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SKETCH_BITS, np.int32)
        total = 0
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            size, one, two = [], [], []
            for tokens in shingle_sets(raw, offsets, width):
                np.add.at(seen, _bucket(tokens), 1)
                total += len(tokens)
                size.append(len(tokens))
                one.append(int(tokens.sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(np.bitwise_xor.reduce(mix(tokens + np.uint64(77))).astype(np.int64)) if len(tokens) else 0)
            yield pa.record_batch(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                names=["id", "n", "f1", "f2"],
            )
        mean = total / len(seen)
        often = np.flatnonzero(seen >= max(6, mean + 6 * mean**0.5))
        yield pa.record_batch(
            [pa.nulls(len(often), pa.int64()), pa.array(seen[often], pa.int64()), pa.array(often), pa.nulls(len(often), pa.int64())],
            names=["id", "n", "f1", "f2"],
        )

    return run


def _indexed(width: int, percent: int, often):
    """Per document: size, fingerprint and index tokens, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counts = often.value
        weight = np.zeros(1 << SKETCH_BITS, np.int32)
        weight[buckets] = counts
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            sizes, picked = [], []
            for tokens in shingle_sets(raw, offsets, width):
                n = len(tokens)
                sizes.append(n)
                if n:
                    # a common holder of every small size keeps the overlap l within reach of the smallest partner
                    length = min(n, n - _needed(n, percent) + int(np.clip(n // 30, 1, 16)))
                    order = np.argsort(weight[_bucket(tokens)], kind="stable")[:length]
                    picked.append(tokens[order].view(np.int64))
                else:
                    picked.append(tokens.view(np.int64))
            limits = np.concatenate([[0], np.cumsum([len(p) for p in picked])]).astype(np.int32)
            flat = np.concatenate(picked) if picked else np.zeros(0, np.int64)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(limits), pa.array(flat))],
                names=["id", "n", "tokens"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            sets = [s.view(np.int64) for s in shingle_sets(raw, offsets, width)]
            limits = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.record_batch(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(limits), pa.array(flat))], names=["id", "tokens"]
            )

    return run


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Sets are made anew, for the documents in pairs only."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = docs.join(growing(wanted), "id", "left_semi").select("id", "text").mapInArrow(_sets(width), "id long, tokens array<long>")
    left, right = (sets.select(F.col("id").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(growing(left), "a").join(growing(right), "b")
        .filter(100 * both >= percent * (F.size("ta") + F.size("tb") - both))
        .select("a", "b")
    )


def _prefixes(grouped: DataFrame) -> DataFrame:
    """(id, n, group, tokens): of each document the index tokens that several groups hold, those of most holders first."""
    often = grouped.groupBy("token").agg(F.count("*").alias("often"), F.min("group").alias("low"), F.max("group").alias("high"))
    often = often.filter("low < high").select("token", "often")
    ordered = F.sort_array(F.collect_list(F.struct("often", "token", "pos")), asc=False)
    return grouped.join(growing(often), "token").groupBy("id", "n", "group").agg(ordered.alias("tokens"))


def link(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id): one row for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    facts = scratch.write(docs.mapInArrow(_facts(width), "id long, n long, f1 long, f2 long"), "facts")

    often = (
        facts.filter("id IS NULL AND f2 IS NULL").groupBy("f1").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "f1").limit(SKETCH_ROWS).toPandas()
    )
    common = spark.sparkContext.broadcast(
        (often["f1"].to_numpy(np.int64), np.minimum(often["n"].to_numpy(np.int64), 2**31 - 1).astype(np.int32))
    )

    sized = facts.filter("f2 IS NOT NULL")
    holds = sized.filter("n > 0 AND id IS NOT NULL")
    first = holds.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    same = holds.join(growing(first), ["n", "f1", "f2"]).filter("id <> rep").select("id", "rep").distinct()
    reps = first.select(F.col("rep").alias("id")).distinct()

    index = scratch.write(
        docs.mapInArrow(_indexed(width, percent, common), "id long, n long, tokens array<long>")
        .filter("n > 0").join(growing(reps), "id", "left_semi")
        .select("id", "n", F.posexplode("tokens").alias("pos", "token")),
        "index",
    )
    held = index.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("token")
    shared = scratch.write(index.join(growing(held), "token"), "shared")
    scratch.drop(index)

    def fits(n, m):
        return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)

    def least_shared(n, m):
        """l of a pair: one that is right for the places of both."""
        return _spare(F.floor(F.greatest(n, m) * percent / 100))

    def early(pos, n, m):
        """Whether a place of a set of size n counts for a partner of size m; the larger m, the fewer places do."""
        both = F.ceil((F.col(n) + F.col(m)) * percent / (100 + percent))
        return F.col(pos) < F.col(n) - both + least_shared(n, m)

    def grouped_by(links: DataFrame) -> DataFrame:
        groups = roots(links, scratch).withColumnRenamed("node", "id")
        return scratch.write(shared.join(growing(groups), "id", "left").withColumn("group", F.coalesce("root", "id")).drop("root"), "grouped")

    links, grouped = None, shared.withColumn("group", F.col("id"))
    for turn in range(STAR_ROUNDS):
        # First the smallest holder, the same for most tokens of a family, then others by hash.
        by = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
        one = grouped.groupBy("token").agg(F.min(F.struct(by.alias("by"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("b_pos"), F.col("group").alias("b_group"))).alias("lead"))
        near = grouped.join(growing(one.select("token", "lead.*")), "token").filter("group <> b_group").filter(fits("n", "m"))
        near = near.filter(early("pos", "n", "m") & early("b_pos", "m", "n"))
        near = near.groupBy(F.col("id").alias("a"), "b", "n", "m").agg(F.count("*").alias("c")).filter(F.col("c") >= least_shared("n", "m"))
        found = scratch.write(_verified(scratch.write(near.select("a", "b"), "stars"), docs, width, percent), "star-links")
        links = found if links is None else links.union(found)
        grouped = grouped_by(links)

    prefixes = scratch.write(_prefixes(grouped), "prefixes")
    asked = prefixes.select("id", "n", "group", F.explode(F.slice("tokens", _spare(F.floor(F.col("n") * percent / 100)).cast("int"), F.size("tokens"))).alias("t"))
    asked = asked.select("id", "n", "group", "t.token", "t.pos")
    other = asked.select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("b_pos"), F.col("group").alias("b_group"))
    met = asked.withColumnRenamed("id", "a").join(growing(other), "token").filter("group > b_group").filter(fits("n", "m"))
    met = scratch.write(met.filter(early("pos", "n", "m") & early("b_pos", "m", "n")).select("a", "n", "b", "m").distinct(), "met")
    one, two = (prefixes.select(F.col("id").alias(k), F.col("n").alias(n), F.col("tokens").alias(f"t{k}")) for k, n in ("an", "bm"))
    both = met.join(growing(one), ["a", "n"]).join(growing(two), ["b", "m"])
    limit = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent)) - least_shared("n", "m")

    def counting(tokens, n):
        return F.transform(F.filter(tokens, lambda t: t["pos"] < F.col(n) - limit), lambda t: t["token"])

    pairs = both.filter(F.size(F.array_intersect(counting("ta", "n"), counting("tb", "m"))) >= least_shared("n", "m")).select("a", "b").distinct()
    more = _verified(scratch.write(pairs, "pairs"), docs, width, percent)

    ends = same.select(F.col("id").alias("a"), F.col("rep").alias("b")).union(links).union(more)
    final = roots(ends, scratch)
    return (
        sized.join(growing(final), sized["id"] == final["node"], "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
posted AS (SELECT doc_id, n, unnest(s) AS t FROM sized),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM posted a JOIN posted b ON a.t = b.t AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (
  WITH RECURSIVE r(node, top) AS (
    SELECT a, a FROM edges UNION SELECT e.b, r.top FROM r JOIN edges e ON e.a = r.node WHERE r.top < e.b)
  SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(top, doc_id) AS component_id
FROM sized LEFT JOIN reach ON node = doc_id"""
