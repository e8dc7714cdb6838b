"""Mixing sources to target weights over a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Every document falls by a hash into one of BLOCKS blocks of its source; a fixed bijection permutes the blocks.
2. Sources, by code point with null last, weigh 5, 2, 1 and so on. A source's target is its weighted share of all
   words, at most MAX_PASSES times its size; with the largest level over all prefixes of the sources in the order of
   cap to weight, target = least(cap, level * weight) is where repeated resharing of the excess ends.
3. A target is so many whole passes over the permuted blocks and a part of one more: the block quota. In the one
   block where the quota ends, documents are taken up to the nearest whole document.
4. The splitting tree deals the slots of all quotas to output shards: each node of the tree draws half of its slots
   at random without replacement, so the counts of each source are a multivariate-hypergeometric draw and add up
   exactly. A shard then draws as many of the source's next permuted blocks; inside it rows are ordered by hash.

The tables of blocks and slots hold BLOCKS rows and MAX_PASSES * BLOCKS rows a source at most, whatever the number
of documents; documents are only joined with them, never ranked but in the one block where a quota ends.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of its own, the
last; repeated rows are taken or left together; an empty table gives an empty table; a source without words has
the target 0. Only id, source and text are read. Reruns agree: everything depends on hashes of ids and sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import Scratch, table

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCKS = 512  # of each source; a power of two
STRIDE, OFFSET = 197, 91  # the bijection of block numbers; the stride is odd
SHARD_BITS = 4
WORD = r"[^\x20\x09-\x0D]+"


def _hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _text_key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _sized(docs: DataFrame, id_col: str, source: str, text: str) -> DataFrame:
    """docs with _id, _source, _size, _h and _place, the permuted number of its block."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    out = docs.withColumns({"_id": F.col(id_col), "_source": F.col(source), "_size": size})
    out = out.withColumn("_h", _hash(F.lit("mix"), _text_key(F.col("_id")), F.col("_size").cast("string")))
    return out.withColumn("_place", ((F.col("_h") % BLOCKS) * STRIDE + OFFSET) % BLOCKS)


def _targets(blocks: DataFrame) -> DataFrame:
    """(source, source_size, rank, target) from the words of blocks."""
    sources = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name).cast("long"))
    step = (F.col("rank") - 1) % len(WEIGHTS)
    weight = F.when(step == 0, WEIGHTS[0]).when(step == 1, WEIGHTS[1]).otherwise(WEIGHTS[2])
    ranked = ranked.withColumn("weight", weight.cast("long"))
    order = Window.orderBy(F.expr("source_size * 10 div weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(MAX_PASSES * F.col("source_size")).over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - capped) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level.cast("double"))
    return leveled.withColumn("level", F.max("level").over(every)).select(
        "source", "source_size", "rank",
        F.least((MAX_PASSES * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def _dealt(quotas: DataFrame) -> DataFrame:
    """(source, place, shards): shards in the order of passes, from (source, rank, n) block quotas."""
    slots = quotas.filter("n > 0").select(
        "source", "rank", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("slot")
    ).withColumn("node", F.lit(0).cast("long"))
    for depth in range(SHARD_BITS):
        draw = _hash(F.lit(f"split{depth}"), F.col("rank").cast("string"), F.col("slot").cast("string"))
        node = Window.partitionBy("node")
        place = F.row_number().over(node.orderBy(draw, "rank", "slot"))
        drawn = slots.withColumns({"_at": place, "_n": F.count("*").over(node)})
        left = F.col("_at") <= F.ceil(F.col("_n") / 2)
        slots = drawn.select("source", "rank", "slot", (F.col("node") * 2 + F.when(left, 0).otherwise(1)).alias("node"))
    # The counts of each shard and source are set; a shard draws that many of the source's next permuted blocks.
    turn = F.row_number().over(Window.partitionBy("rank").orderBy("node", "slot")) - 1
    runs = slots.select("source", F.col("node").alias("shard"), turn.alias("turn"))
    return runs.groupBy("source", (F.col("turn") % BLOCKS).alias("place")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "shard"))), lambda s: s["shard"]).alias("shards")
    )


def plan(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(blocks, ends): what each block of each source gives, and the documents taken where quotas end."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(
        _sized(docs, id_col, source, text).groupBy(
            F.col("_source").alias("source"), F.col("_id").cast("string").alias("id"), F.col("_size").alias("size"),
            F.col("_h").alias("h"), F.col("_place").alias("place"),
        ).agg(F.count("*").alias("copies")),
        "sizes",
    )
    blocks = rows.groupBy("source", "place").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    blocks = scratch.write(blocks, "blocks")
    targets = scratch.write(_targets(blocks), "targets")
    known = blocks.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    run = Window.partitionBy("rank").orderBy("place")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    spread = (
        known.withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("upto", F.sum("words").over(run))
        .withColumn("before", F.col("upto") - F.col("words"))
        .withColumn("whole", (F.col("upto") <= F.col("rest")).cast("long"))
        .withColumn("ends", (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest")))
    )
    # Blocks without documents are in no table, but they have a place in the permutation and slots of every pass.
    last = F.max(F.when((F.col("whole") == 1) | F.col("ends"), F.col("place") + 1).otherwise(0))
    quotas = spread.groupBy("source", "rank").agg((F.first("passes") * BLOCKS + last).alias("n"))
    dealt = _dealt(quotas).withColumnsRenamed({"source": "ds", "place": "dp"})
    spread = spread.join(
        dealt, F.col("source").eqNullSafe(F.col("ds")) & (F.col("place") == F.col("dp")), "left"
    ).drop("ds", "dp")
    spread = scratch.write(spread, "spread")
    ending = spread.filter("ends").select(
        F.col("source").alias("es"), F.col("place").alias("ep"), "rank", (F.col("rest") - F.col("before")).alias("open")
    )
    cut = Window.partitionBy("rank").orderBy("h", "id", "size")
    ends = (
        rows.join(ending, F.col("source").eqNullSafe(F.col("es")) & (F.col("place") == F.col("ep")))
        .withColumn("weight", F.col("size") * F.col("copies"))
        .withColumn("upto", F.sum("weight").over(cut))
        .filter((F.col("weight") > 0) & (2 * F.col("upto") - F.col("weight") < 2 * F.col("open")))
        .select("source", "id", "size", "h")
    )
    return spread, scratch.write(ends, "ends")


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The input with _size, _source_size, _target, _taken and _shards, one shard for each time the row is taken."""
    spread, ends = plan(docs, id_col, source, text)
    sized = _sized(docs, id_col, source, text)
    blocks = spread.select(*[F.col(c).alias(f"_b_{c}") for c in ("source", "place", "source_size", "target", "passes", "whole", "ends", "shards")])
    extra = ends.select(*[F.col(c).alias(f"_e_{c}") for c in ("source", "id", "size", "h")])
    out = sized.join(blocks, F.col("_source").eqNullSafe(F.col("_b_source")) & (F.col("_place") == F.col("_b_place")))
    out = out.join(
        extra,
        F.col("_source").eqNullSafe(F.col("_e_source")) & F.col("_id").cast("string").eqNullSafe(F.col("_e_id"))
        & (F.col("_size") == F.col("_e_size")) & (F.col("_h") == F.col("_e_h")),
        "left",
    )
    more = F.when(F.col("_b_ends"), F.col("_e_h").isNotNull().cast("long")).otherwise(F.col("_b_whole"))
    times = F.when(F.col("_size") > 0, F.col("_b_passes") + more).otherwise(0).cast("int")
    return out.withColumns(
        {
            "_source_size": F.col("_b_source_size"),
            "_target": F.col("_b_target"),
            "_taken": times * F.col("_size"),
            "_shards": F.slice(F.coalesce("_b_shards", F.array().cast("array<bigint>")), F.lit(1), times),
        }
    ).select(*docs.columns, "_size", "_source_size", "_target", "_taken", "_shards", "_h")


def draw_documents(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it; columns as they were."""
    mixed = mix(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text"))
    return mixed.select("_row", F.explode("_shards")).select("_row.*")


def write_shards(docs: DataFrame, path: str, salt: int = 8) -> None:
    """The mix as files, a folder for each shard; rows are in the order of a hash, in `salt` files a shard."""
    mixed = mix(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text"))
    rows = mixed.select("_row", "_h", F.posexplode("_shards").alias("pass", "shard"))
    rows = rows.withColumn("_order", F.xxhash64("_h", "pass"))
    dealt = rows.repartition("shard", F.pmod("_order", F.lit(salt))).sortWithinPartitions("shard", "_order")
    dealt.select("shard", "_row.*").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"),
        F.array_join(F.col("_shards").cast("array<string>"), ",").alias("shards"),
    )


def oracle(source: str = "documents") -> str:
    """The same mix in DuckDB's SQL: one row a document, with its shards."""
    h = lambda *p: f"('0x' || substr(md5({" || '|' || ".join(p)}), 1, 15))::BIGINT"
    levels = "".join(
        f"""
tree{d + 1} AS (
  SELECT source, rank, slot, node * 2 + CASE WHEN pos <= ceil(n / 2) THEN 0 ELSE 1 END AS node FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY {h(f"'split{d}'", "rank", "slot")}, rank, slot) AS pos,
      count(*) OVER (PARTITION BY node) AS n FROM tree{d})),"""
        for d in range(SHARD_BITS)
    )
    return f"""
sized AS (
  SELECT *, {h("'mix'", "coalesce(doc_id::VARCHAR, 'null')", "size")} AS h FROM (
    SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {source})),
placed AS (SELECT *, ((h % {BLOCKS}) * {STRIDE} + {OFFSET}) % {BLOCKS} AS place FROM sized),
blocks AS (SELECT source, place, sum(size)::BIGINT AS words FROM placed GROUP BY source, place),
sources AS (SELECT source, sum(words)::BIGINT AS source_size FROM blocks GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sources),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM ranked),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum({MAX_PASSES} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY source_size * 10 // weight, rank)),
targets AS (
  SELECT source, source_size, rank, least(({MAX_PASSES} * source_size)::DOUBLE, (SELECT max(level) FROM leveled) * weight) AS target FROM leveled),
spread AS (
  SELECT *, upto - words AS before, upto <= rest AS whole, upto - words < rest AND upto > rest AS ends FROM (
    SELECT *, target - passes * source_size AS rest, sum(words) OVER (PARTITION BY rank ORDER BY place)::BIGINT AS upto FROM (
      SELECT b.place, b.words, t.*, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes
      FROM blocks b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source))),
quotas AS (
  SELECT source, rank, first(passes) * {BLOCKS} + max(CASE WHEN whole OR ends THEN place + 1 ELSE 0 END) AS n FROM spread GROUP BY source, rank),
tree0 AS (SELECT source, rank, unnest(range(n)) AS slot, 0::BIGINT AS node FROM quotas WHERE n > 0),{levels}
runs AS (SELECT source, node AS shard, row_number() OVER (PARTITION BY rank ORDER BY node, slot) - 1 AS turn FROM tree{SHARD_BITS}),
dealt AS (SELECT source, turn % {BLOCKS} AS place, list(shard ORDER BY turn) AS shards FROM runs GROUP BY ALL),
chosen AS (
  SELECT p.*, s.rank, s.source_size, s.target, s.passes, s.whole, s.ends, s.rest - s.before AS open,
    sum(p.size) OVER (PARTITION BY s.rank, s.place ORDER BY p.h, p.doc_id::VARCHAR, p.size) AS upto,
    sum(p.size) OVER (PARTITION BY s.rank, s.place, p.h, p.doc_id, p.size) AS weight,
    coalesce(d.shards, []) AS shards
  FROM placed p JOIN spread s ON p.source IS NOT DISTINCT FROM s.source AND p.place = s.place
    LEFT JOIN dealt d ON p.source IS NOT DISTINCT FROM d.source AND p.place = d.place),
mixed AS (
  SELECT *, CASE WHEN size > 0 THEN passes + CASE WHEN ends THEN (2 * upto - weight < 2 * open)::INT ELSE whole::INT END ELSE 0 END AS times
  FROM chosen)"""


ORACLE_SQL = f"""WITH {oracle()}
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (times * size)::BIGINT AS taken,
  array_to_string(shards[1:times], ',') AS shards FROM mixed"""
