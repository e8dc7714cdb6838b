"""Fuzzy line dedup by MinHash, in DataFrame operations only.

A line counts by its normal form: lower case, runs of white space as one blank, trimmed; blank lines are left alone.
Two lines are near copies if the Jaccard similarity of their sets of character shingles (WIDTH code points, every
offset; a shorter line is one shingle) reaches PERCENT. One line of each component stays: the first by document and
line number.

1. Signature: the hashes of character shingles, sorted, are a circle; the ROWS hashes that follow each of BANDS fixed
   points on it are a band. That is MinHash by one permutation and its rotations: a band agrees with a chance of
   similarity ** ROWS, and a difference of d shingles touches few bands of a short line. A line signs the distinct
   shingles that follow a lead character, if they are LED_FROM at least; one with fewer those that follow one of twice as
   many half-leads, if they are HALF_FROM at least; one with fewer all. Up to FULL_TO and HALF_TO it signs the next
   kind too, so that near copies on either side of a limit meet. Leads are every fourth character of ASCII, half-leads
   every second, and all others are both, so lines of any script have many. A line signs in the pass that reads it: texts
   aren't shuffled.
2. Equal lines meet by hash; from here on a line stands for all of its kind.
3. Banding: in LEAD_ROUNDS rounds the lines of each band are held against one of them, if the two aren't in one
   component yet. Of bands that still hold several components, those of up to FEW lines have all their pairs compared;
   larger ones give their lines to a prefix filter: a line's shingles are put in the order of how many of these lines
   have them, after those that only its component has, and two near copies share one of the first fifth of both. Pairs
   are formed where components meet in such a shingle, at the first that two lines share, if lengths and places in the
   order allow a near copy; lines of one template, which share common shingles
   only, don't meet. First each line is held against the one that shares most such shingles with it, which leaves few
   components. Both ways are exact: once two lines share a band, the chance of which is
   1 - (1 - similarity ** ROWS) ** BANDS, neither can lose them.
4. Verification: a pair whose maps of shingle bits differ in more places than near copies have shingles apart is
   left; of the others, the exact similarity over all shingles of both lines.
5. Distributed union-find over verified links.

Defined results: null and empty texts have no lines; null ids count as the last document; rows of the same id are
the same document if their texts are equal; repeated rows keep or lose the same lines; an empty table gives an empty
table. Other columns are carried along by `drop_lines` and ignored by `judge_lines`. Lines are told apart by a
64-bit hash of their normal form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import SPACES, Scratch, growing, table
from lakesift.llm.components import roots

WIDTH = 8
PERCENT = 80
BANDS = 10
ROWS = 3
LED_FROM, FULL_TO = 24, 36  # shingles after lead characters: from how many they sign, and up to how many the next kind does
HALF_FROM, HALF_TO = 32, 48  # the same of shingles after half-leads
LEAD_ROUNDS = 1  # after the first
WORDS = 16  # of 64 bits: what a line is known by before it is verified
FEW = 64  # lines of a band that are held against each other as they are


def normal(text: Column) -> Column:
    """The text with its lines in normal form, but for blanks at their ends."""
    # Single blanks, which most are, don't match, and texts that have no others don't meet the pattern.
    plain = ~text.contains("  ")
    for c in "\t\x0b\x0c\r":
        plain &= ~text.contains(c)
    spaced = F.regexp_replace(F.lower(text), r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+", " ")
    return F.when(plain, F.lower(text)).otherwise(spaced)


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, tid, pos, line): the lines of every text with a word, in their normal form."""
    body = F.coalesce(F.col(text), F.lit(""))
    # Outer: else Spark makes the array once more to test its size. Texts are made normal as a whole, before the explode.
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("tid"), F.posexplode_outer(F.split(normal(body), "\n")).alias("pos", "line"))
    return own.withColumn("line", F.trim("line")).filter("line <> ''")


def shingles(line: Column) -> Column:
    """Every WIDTH characters of a line; a short line is one."""
    return F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{WIDTH}}}|^.{{1,{WIDTH - 1}}}\\z))"), F.lit(1))


_STEP = (1 << 64) // BANDS
POINTS = [-(1 << 63) + b * _STEP + _STEP // 2 for b in range(BANDS)]


def _led(line: Column, every: int) -> Column:
    """The WIDTH characters after each lead character: shingles picked by what stands before them. One of so many
    characters of ASCII is one, and each other character."""
    no_lead = "".join(f"\\x{c:02x}" for c in range(128) if c % every != every - 1)
    return F.regexp_extract_all(line, F.lit(f"(?s)[^{no_lead}](?=(.{{{WIDTH}}}))"), F.lit(1))


def _circle(texts: Column) -> Column:
    return F.array_distinct(F.sort_array(F.transform(texts, lambda s: F.xxhash64(s))))


def _kinds(lines: DataFrame) -> DataFrame:
    """The input with `_h`, the hashes that a line signs by, once for each kind of signature, and their number as `kind`."""
    out = lines.withColumn("_led", _circle(_led(F.col("line"), 4)))
    out = out.withColumn("_half", F.when(F.size("_led") < FULL_TO, _circle(_led(F.col("line"), 2))))
    every = F.when(F.col("_half").isNotNull() & (F.size("_half") < HALF_TO), _circle(shingles(F.col("line"))))
    half = F.when(F.size("_half") >= HALF_FROM, F.col("_half"))
    led = F.when(F.size("_led") >= LED_FROM, F.col("_led"))
    kinds = F.filter(F.array(every, half, led), lambda h: h.isNotNull())
    return out.withColumn("_kinds", kinds).select(*lines.columns, F.posexplode_outer("_kinds").alias("kind", "_h"))


def _signed(lines: DataFrame) -> DataFrame:
    """The input with `keys` and `kind`, once for each kind of signature. What all bands share is a column of its own, so
    that it is made once."""
    points = F.array(*[F.lit(p).cast("long") for p in POINTS])
    out = _kinds(lines)
    out = out.withColumns({"_m": F.sort_array(F.concat("_h", points)), "_c": F.concat("_h", F.slice("_h", 1, ROWS))})  # the circle closes
    keys = []
    for b, point in enumerate(POINTS):
        at = F.array_position("_m", F.lit(point).cast("long")) - b
        keys.append(F.xxhash64(F.lit(b), F.slice("_c", at.cast("int"), ROWS)))
    return out.withColumn("keys", F.array(*keys)).drop("_h", "_m", "_c")


def _hashes(line: Column) -> Column:
    return F.transform(shingles(line), lambda s: F.xxhash64(s))


def _prints(lines: DataFrame) -> DataFrame:
    """line_id, line, the number of distinct shingles, and a map of WORDS * 64 bits: how often each was hit by a shingle's
    hash, odd or even. Sorted, the hashes of a word lie together, so all words are one pass over them."""
    # Each array is named more than once, as Spark makes it again for each use, and slower, where it can merge the columns.
    starts = [F.lit(-(1 << 63) + w * ((1 << 64) // WORDS)).cast("long") for w in range(WORDS)]
    out = lines.withColumn("set", F.array_distinct(_hashes(F.col("line"))))
    out = out.withColumn("_m", F.sort_array(F.concat("set", F.array(*starts))))
    at = [F.array_position("_m", start).cast("int") for start in starts] + [F.size("_m") + 1]
    bit = lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))
    parts = {f"_part{w}": F.slice("_m", at[w] + 1, at[w + 1] - at[w] - 1) for w in range(WORDS)}
    out = out.select("line_id", "line", F.size("set").alias("size"), *[part.alias(name) for name, part in parts.items()])
    none = F.lit(0).cast("long")
    bits = [F.when(F.size(name) > 0, F.aggregate(name, none, bit)).otherwise(none).alias(f"bits{w}") for w, name in enumerate(parts)]
    return out.select("line_id", "line", "size", *bits)


PRINT = ["size", *[f"bits{w}" for w in range(WORDS)]]


def _may_link(one: str, two: str) -> Column:
    """Whether two lines may be near copies by their maps, which differ where an odd number of the shingles that only one
    of them has falls: in as many places as such shingles at most."""
    apart = sum((F.bit_count(F.col(f"{one}bits{w}").bitwiseXOR(F.col(f"{two}bits{w}"))) for w in range(WORDS)), F.lit(0))
    return apart * (100 + PERCENT) <= (100 - PERCENT) * (F.col(f"{one}size") + F.col(f"{two}size"))


def _verified(pairs: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are near copies."""
    one, two = (held.select(F.col("line_id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ["line", *PRINT]]) for k in "ab")
    both = pairs.join(growing(one), "a").join(growing(two), "b").filter(_may_link("a_", "b_"))
    # Columns of their own, and a filter only after they are written: each array is made once for a pair.
    both = both.select("a", "b", (F.col("a_size") + F.col("b_size")).alias("n"), *[_hashes(F.col(f"{k}_line")).alias(f"all_{k}") for k in "ab"])
    both = both.select("a", "b", "n", F.size(F.array_intersect("all_a", "all_b")).alias("both"))
    tested = scratch.write(both.select("a", "b", (100 * F.col("both") >= PERCENT * (F.col("n") - F.col("both"))).alias("near")), "links")
    return tested.filter("near").select("a", "b")


class _Search:
    """The verified links so far, and the pairs that were tried."""

    def __init__(self, held: DataFrame, scratch: Scratch):
        self.held, self.scratch = held, scratch
        self.found: DataFrame | None = None
        self.tried: DataFrame | None = None

    def settle(self, pairs: DataFrame) -> None:
        """Verifies the pairs that were not tried before."""
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(growing(self.tried), ["a", "b"], "left_anti")
        pairs = self.scratch.write(pairs, "pairs")
        links = _verified(pairs, self.held, self.scratch)
        self.found = links if self.found is None else self.found.union(links)
        self.tried = pairs if self.tried is None else self.tried.union(pairs)

    def rooted(self, rows: DataFrame) -> DataFrame:
        """The rows with the root of their line's component by the links so far."""
        groups = roots(self.found, self.scratch).withColumnRenamed("node", "line_id")
        return self.scratch.write(rows.join(growing(groups), "line_id", "left").withColumn("root", F.coalesce("root", "line_id")), "rooted")


def _open(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys that hold more than one component, with the number of their rows as n."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    return rows.join(growing(sizes.filter("low <> high").select(key, "n")), key)


def _all_pairs(rows: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """All pairs of rows of a band that are of different components and may be near copies."""
    rows = rows.select("key", "line_id", "root").join(growing(held.select("line_id", *PRINT)), "line_id")
    rows = scratch.write(rows, "printed")
    one, two = (rows.select("key", *[F.col(c).alias(f"{k}_{c}") for c in ["line_id", "root", *PRINT]]) for k in "ab")
    pairs = one.join(growing(two), "key").filter("a_line_id > b_line_id AND a_root <> b_root").filter(_may_link("a_", "b_"))
    return pairs.select(F.col("a_line_id").alias("a"), F.col("b_line_id").alias("b"))


def _early(rows: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, line_id, root, size, place): of each line the shingles that come first by how many of the lines have them,
    so many that near copies share one. Shingles of one component only come before all others: no line of another one has
    them, so they take places and are left out."""
    own = rows.select("line_id", "root").distinct().join(growing(held.select("line_id", "line")), "line_id")
    own = own.withColumn("set", F.array_distinct(_hashes(F.col("line"))))
    every = scratch.write(own.select("line_id", "root", F.size("set").alias("size"), F.explode_outer("set").alias("token")), "shingles")
    ordered = _open(every, "token").groupBy("line_id", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("order"))
    least = F.ceil(F.col("size") * PERCENT / 100).cast("int")  # what a near copy of any size shares
    ordered = ordered.withColumn("alone", F.col("size") - F.size("order")).withColumn("many", F.col("size") - least + 1 - F.col("alone")).filter("many > 0")
    first = ordered.select("line_id", "root", "size", "alone", F.posexplode_outer(F.slice("order", F.lit(1), F.col("many"))).alias("at", "one"))
    early = scratch.write(first.select("line_id", "root", "size", (F.col("alone") + F.col("at")).alias("place"), "one.token"), "early")
    scratch.drop(every)
    return scratch.write(_open(early, "token").drop("n"), "open-shingles")


def _close(pairs: DataFrame) -> DataFrame:
    """Pairs that lengths and the places of a shared shingle, if it is the first that they share, allow to be near copies."""
    both = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    fit = F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * PERCENT
    return pairs.filter(fit & (both * (100 + PERCENT) >= (F.col("a_size") + F.col("b_size")) * PERCENT))


def _side(early: DataFrame, side: str, *more: str) -> DataFrame:
    return early.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("root", "line_id", "size", "place", *more)])


def _best(early: DataFrame) -> DataFrame:
    """For each line the one that it shares most early shingles with, of those that are the first of a shingle by hash."""
    lead = early.groupBy("token").agg(F.min_by(F.struct("root", "line_id", "size", "place"), F.xxhash64("line_id", "token")).alias("l"))
    lead = lead.select("token", *[F.col(f"l.{c}").alias(f"b_{c}") for c in ("root", "line_id", "size", "place")])
    met = _close(_side(early, "a").join(growing(lead), "token").filter("a_root <> b_root"))
    shared = met.groupBy("a_line_id", "b_line_id").agg(F.count("*").alias("n"))
    return shared.groupBy(F.col("a_line_id").alias("a")).agg(F.max_by("b_line_id", F.struct("n", "b_line_id")).alias("b"))


def _meet(early: DataFrame) -> DataFrame:
    """(token, a_root, b_root): components that hold lines that the shingle allows to be near copies. What a pair of their
    lines can reach at most is told here, so components that only share a late shingle don't open their lines."""
    sides = early.groupBy("token", "root").agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.max(F.col("size") - F.col("place")).alias("reach")
    )
    one, two = (sides.select("token", *[F.col(c).alias(f"{k}_{c}") for c in ("root", "low", "high", "reach")]) for k in "ab")
    fit = (F.col("a_high") * 100 >= F.col("b_low") * PERCENT) & (F.col("b_high") * 100 >= F.col("a_low") * PERCENT)
    both = F.least("a_reach", "b_reach") * (100 + PERCENT) >= (F.col("a_low") + F.col("b_low")) * PERCENT
    return one.join(growing(two), "token").filter("a_root > b_root").filter(fit & both).select("token", "a_root", "b_root", "b_low", "b_reach")


def _led_by(early: DataFrame) -> DataFrame:
    """The rows with `before`: the line's shingles that come before the row's own."""
    own = early.groupBy("line_id", "root", "size").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("order"))
    own = own.select("line_id", "root", "size", "order", F.posexplode_outer("order").alias("at", "one"))
    return own.select("one.token", "line_id", "root", "size", "one.place", F.slice(F.col("order.token"), F.lit(1), F.col("at")).alias("before"))


def _apart(early: DataFrame) -> DataFrame:
    """All pairs of lines of different components that may be near copies, each formed at the first shingle that they share."""
    # Components meet first, then their lines: a large family next to a few lines costs its size.
    rows = _led_by(early)
    asks = _meet(early).join(growing(_side(rows, "a", "before")), ["token", "a_root"])
    asks = asks.filter(F.least(F.col("a_size") - F.col("a_place"), "b_reach") * (100 + PERCENT) >= (F.col("a_size") + F.col("b_low")) * PERCENT)
    pairs = _close(asks.join(growing(_side(rows, "b", "before")), ["token", "b_root"])).filter(~F.arrays_overlap("a_before", "b_before"))
    return pairs.select(F.col("a_line_id").alias("a"), F.col("b_line_id").alias("b"))


def _links(seen: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified (a, b), a > b, that join near copies that share bands. Texts are read again once, for lines in question."""
    every = seen.select("line_id", F.explode_outer("keys").alias("key"))
    # A window, so that the keys, most of which one line has alone, are shuffled and sorted once and not gathered in hash tables.
    band = Window.partitionBy("key")
    met = every.withColumns({"lead": F.min("line_id").over(band), "last": F.max("line_id").over(band)}).filter("lead <> last")
    met = scratch.write(met.select("line_id", "key", "lead").distinct(), "met")
    # The hash table is that of ids in question; texts stream by and aren't sorted.
    held = lines.join(met.select("line_id").distinct().hint("shuffle_hash"), "line_id", "left_semi")
    held = scratch.write(_prints(held.distinct()), "held")
    search = _Search(held, scratch)
    search.settle(met.filter("line_id <> lead").select(F.col("line_id").alias("a"), F.col("lead").alias("b")))
    met = met.select("line_id", "key")
    for turn in range(LEAD_ROUNDS):
        # A lead by hash: another one in each round, and seldom the same for all bands of a family.
        rows = search.rooted(met)
        by = F.xxhash64("line_id", F.lit(turn))
        leads = rows.groupBy("key").agg(F.min(F.struct(by.alias("h"), "line_id", "root")).alias("l"))
        pairs = rows.join(growing(leads), "key").filter("root <> l.root")
        search.settle(pairs.select(F.col("line_id").alias("a"), F.col("l.line_id").alias("b")))
    rows = scratch.write(_open(search.rooted(met), "key").filter("n > 2"), "open")
    pairs = _all_pairs(rows.filter(F.col("n") <= FEW), held, scratch)
    early = _early(rows.filter(F.col("n") > FEW), held, scratch)
    search.settle(pairs.union(_best(early)))
    search.settle(_apart(scratch.write(_open(search.rooted(early.drop("root")), "token").drop("n"), "open-shingles")))
    return search.found


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tid, positions): the lines that go, for each document that loses any. tid is a hash of its text."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = _lines(docs, id_col, text).withColumn("line_id", F.xxhash64("line"))
    place = F.struct(F.col("id").isNull().alias("n"), "id", "pos", "tid")
    seen = scratch.write(_signed(lines).drop("line"), "lines")
    links = _links(seen, lines.select("line_id", "line"), scratch)
    groups = roots(links, scratch)
    member = groups.select(F.col("node").alias("line_id"), "root").union(groups.select(F.col("root").alias("line_id"), "root"))
    own = seen.filter("kind = 0").drop("keys", "kind")
    # Lines that stand alone, once and in no component, need no decision.
    often = own.groupBy("line_id").agg(F.count("*").alias("n")).filter("n > 1").select("line_id", F.lit(None).cast("long").alias("root"))
    asked = member.union(often).groupBy("line_id").agg(F.coalesce(F.min("root"), "line_id").alias("root"))
    rows = scratch.write(own.join(growing(asked), "line_id").drop("line_id"), "rooted")
    best = rows.groupBy("root").agg(F.min(place).alias("stays"))
    gone = rows.join(growing(best), "root").filter(~F.col("stays").eqNullSafe(place))
    return scratch.write(gone.groupBy("id", "tid").agg(F.array_distinct(F.collect_list("pos")).alias("positions")), "gone")


def _with_dropped(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    gone = dropped_lines(docs, id_col, text).withColumnsRenamed({"id": "_gid", "tid": "_gtid", "positions": "_gone"})
    tid = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.join(growing(gone), F.col(id_col).eqNullSafe(F.col("_gid")) & (tid == F.col("_gtid")), "left")


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_lines, n_removed, removed): lines with a word, and the numbers (from 0) of the lines that go."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(body).alias("tid"),
        F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long").alias("n_lines"),
    )
    gone = dropped_lines(docs, id_col, text).withColumnsRenamed({"id": "gid", "tid": "gtid"})
    out = own.join(growing(gone), F.col("id").eqNullSafe(F.col("gid")) & (F.col("tid") == F.col("gtid")), "left")
    removed = F.sort_array(F.coalesce("positions", F.array().cast("array<int>")))
    return out.select(F.col("id").alias(id_col), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines that go; a document that had lines and lost all of them goes too.

    An n_chars column, where there is one, follows the text; other columns stay as they were."""
    keep = docs.columns
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    full = _with_dropped(rows, "doc_id", "text")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    full = full.withColumn("_text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest))
    full = full.filter(F.col("_gone").isNull() | (F.length(F.btrim("_text", F.lit(SPACES))) > 0))
    fresh = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return full.select(*[fresh[c].alias(c) if c in fresh else F.col("_row")[c].alias(c) for c in keep])


def query(spark, sf_dir: str) -> DataFrame:
    out = judge_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


#: The same result over all pairs of distinct lines that share a shingle; each shingle set is made whole.
PREFIX_SQL = """
lines AS (
  SELECT doc_id, pos - 1 AS pos, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {source})),
full_lines AS (SELECT * FROM lines WHERE line <> ''),
firsts AS (SELECT line, min((doc_id IS NULL, doc_id, pos)) AS first FROM full_lines GROUP BY line),
sets AS (
  SELECT line, CASE WHEN length(line) < {w} THEN [line] ELSE list_distinct(list_transform(
    range(1, length(line) - {w} + 2), lambda i: substr(line, i, {w}))) END AS s FROM firsts),
posted AS (SELECT line, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.line AS a, b.line AS b FROM posted a JOIN posted b ON a.t = b.t AND a.line < b.line
    AND 100 * least(a.n, b.n) >= {p} * greatest(a.n, b.n)
  GROUP BY a.line, b.line, a.n, b.n HAVING 100 * count(*) >= {p} * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (
  WITH RECURSIVE r(node, top) AS (
    SELECT a, a FROM edges UNION SELECT e.b, r.top FROM r JOIN edges e ON e.a = r.node WHERE r.top < e.b)
  SELECT node, min(top) AS top FROM r GROUP BY node),
rooted AS (SELECT line, first, coalesce(top, line) AS root FROM firsts LEFT JOIN reach ON node = line),
stays AS (SELECT root, min(first) AS stays FROM rooted GROUP BY root),
gone AS (
  SELECT doc_id, pos FROM full_lines JOIN rooted USING (line) JOIN stays USING (root)
  WHERE stays <> (doc_id IS NULL, doc_id, pos))"""


def oracle(source: str = "documents") -> str:
    return PREFIX_SQL.format(source=source, w=WIDTH, p=PERCENT)


ORACLE_SQL = f"""WITH {oracle()},
counted AS (SELECT doc_id, count(*) AS n FROM full_lines GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(l.n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN lost l USING (doc_id)"""
