"""Line-first quality rules, as DataFrame expressions only.

Each line of a text is held against rules of punctuation, navigation and boilerplate; lines that fail are
removed, and a document that loses too much of its text that way is rejected. Nothing is shuffled: every
count stays inside its row, so one very long text costs time in proportion to its own length.

Defined results: a null or empty text has no words and fails the base rules; blank lines never fail a rule
and never count as repeats; ties and repeated rows are judged alike, row by row; an empty table gives an
empty table. Columns of the input stay; result columns that clash with one replace it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import SPACES, count_of, words_of

SYMBOLS = "#*$%&|<>"
#: What may end a sentence, before closing quotes or brackets too.
TERMINAL = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？")
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use of cookies",
    "enable javascript",
    "lorem ipsum",
    "click here to",
    "sign up for our newsletter",
    "alle rechte vorbehalten",
    "nutzungsbedingungen",
    "datenschutzerklärung",
    "tous droits réservés",
    "conditions d'utilisation",
    "politique de confidentialité",
    "todos los derechos reservados",
    "términos de uso",
    "política de privacidad",
)


@dataclass(frozen=True)
class Rules:
    window: int = 8  # words in a window that is looked for again
    min_words: int = 20
    max_repeat_percent: int = 30
    unpunctuated_words: int = 12  # a line without an end mark passes from so many words on
    line_symbol_percent: int = 20  # symbols for 100 words of a line
    line_shout_percent: int = 50  # exclamation marks for 100 words of a line
    nav_bars: int = 2  # separator bars that make a line navigation
    max_lost_percent: int = 50  # words lost with removed lines before the document goes


def repeated_words(words: Column, window: int) -> tuple[Column, Column]:
    """(hashes of all word windows, function of the hash column to the words lying in windows found again)."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return hashes, F.transform(
        F.sequence(F.lit(0), F.size(words) - window),
        lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(window)]),
    )


def _covered(windows: Column, window: int) -> Column:
    """Words inside windows whose hash occurs twice or more: the length of a union of intervals."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.size(windows) - 1),
            lambda k: F.when(
                (F.get(F.col("_ranked"), k - 1)["h"] == F.get(F.col("_ranked"), k)["h"])
                | (F.get(F.col("_ranked"), k + 1)["h"] == F.get(F.col("_ranked"), k)["h"]),
                F.get(F.col("_ranked"), k)["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return ranked, again


def _line_fails(line: Column, rules: Rules) -> Column:
    bare = F.translate(line, SPACES, " " * len(SPACES))  # tabs and carriage returns part and end words like blanks

    def tests(made: Column) -> Column:
        words, lower = made["words"], made["lower"]
        ended = F.right(made["tail"], F.lit(1)).isin(*TERMINAL)
        boiler = F.lit(False)
        for phrase in BOILERPLATE:
            boiler = boiler | F.contains(lower, F.lit(phrase))
        return (words > 0) & (
            (~ended & (words < rules.unpunctuated_words))
            | (count_of(line, SYMBOLS) * 100 > words * rules.line_symbol_percent)
            | (count_of(line, "!") * 100 > words * rules.line_shout_percent)
            | (count_of(line, "|") >= rules.nav_bars)
            | boiler
        )

    # The one element of an array names what the tests share, so that a line is cut and lowered once and not for every test.
    made = F.struct(
        F.size(F.array_remove(F.split(bare, " "), "")).alias("words"), F.rtrim(bare).alias("tail"), F.lower(line).alias("lower")
    )
    return F.element_at(F.transform(F.array(made), tests), 1)


#: Columns that `judge` makes on its way.
STEPS = ("_body", "_words", "_hashes", "_windows", "_ranked", "_again", "_lines", "_good")


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text,
    n_lines, n_removed, n_lost_words and kept.

    Input columns with one of these names are replaced; those named as one of STEPS are kept."""
    aside = {c: f"{c} of the input" for c in docs.columns if c in STEPS}
    docs, text = docs.withColumnsRenamed(aside), aside.get(text, text)
    k = rules.window
    body = F.coalesce(F.col(text), F.lit(""))
    full = docs.withColumn("_body", body).withColumn("_words", words_of(F.col(text)))
    hashes, windows = repeated_words(F.col("_words"), k)
    full = full.withColumn("_hashes", hashes).withColumn(
        "_windows", F.when(F.size("_words") >= k, windows).otherwise(F.array().cast("array<bigint>"))
    )
    ranked, again = _covered(F.col("_windows"), k)
    unique = F.size(F.array_distinct("_windows")) == F.size("_windows")
    full = full.withColumn("_ranked", F.when(~unique, ranked)).withColumn(
        "_again", F.when(F.col("_ranked").isNotNull(), F.array_sort(again))
    )
    # Each start covers the words up to the next start, k at most; the last covers k.
    steps = F.transform(
        F.col("_again"),
        lambda p, j: F.least(F.lit(k), F.coalesce(F.get(F.col("_again"), j + 1) - p, F.lit(k))),
    )
    lines = F.split(F.col("_body"), "\n")
    full = full.withColumn("_lines", F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    full = full.withColumn("_good", F.filter("_lines", lambda x: ~_line_fails(x, rules)))
    n_words = F.size("_words")
    kept_words = F.size(words_of(F.array_join("_good", "\n")))
    out = (
        full.withColumn("n_words", n_words.cast("long"))
        .withColumn("word_chars", (F.length("_body") - count_of(F.col("_body"), SPACES)).cast("long"))
        .withColumn("n_symbols", count_of(F.col("_body"), SYMBOLS).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn(
            "n_repeat_words",
            F.when(
                F.col("_again").isNotNull(), F.aggregate(steps, F.lit(0), lambda a, x: a + x)
            ).otherwise(0).cast("long"),
        )
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_removed", (F.size("_lines") - F.size("_good")).cast("long"))
        .withColumn("clean_text", F.array_join("_good", "\n"))
        .withColumn("n_lost_words", (F.size("_words") - kept_words).cast("long"))
    )
    out = out.withColumn(
        "base_failed",
        (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    ).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= rules.max_lost_percent * F.col("n_words"))
    )
    return out.drop(*STEPS).withColumnsRenamed({new: old for old, new in aside.items()})


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def query(spark, sf_dir: str) -> DataFrame:
    from lakesift.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", *COUNTS, "base_failed", "n_lines", "n_removed", "n_lost_words", "kept"
    )


def filter_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Documents that pass, with the lines that failed taken out of their text; other columns as they were.

    An n_chars column, where there is one, follows the text."""
    keep = docs.columns
    judged = judge(docs.select(F.struct("*").alias("_row"), F.col("text").alias("text")), rules)
    # A column that may not be computed twice keeps the filter above the rules; pushed below, it would repeat them all.
    judged = judged.withColumn("_at", F.monotonically_increasing_id()).filter(F.col("kept") & (F.col("_at") >= 0))
    fresh = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[fresh[c].alias(c) if c in fresh else F.col("_row")[c].alias(c) for c in keep])


def _in(chars: str) -> str:
    return "[" + "".join("\\" + c for c in chars) + "]"


def oracle(source: str = "documents", rules: Rules = Rules()) -> str:
    """The same rules in DuckDB's SQL, one row a document, with clean_text."""
    k = rules.window
    terminal = ", ".join("'" + t.replace("'", "''") + "'" for t in TERMINAL)
    boiler = " OR ".join(f"contains(lower(x), '{b.replace(chr(39), chr(39) * 2)}')" for b in BOILERPLATE)
    words = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    bare = "translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '      ')"
    n_line = f"len(list_filter(string_split({bare}, ' '), lambda w: w <> ''))"
    hits = lambda c: f"(length(x) - length(regexp_replace(x, '{c}', '', 'g')))"
    fails = (
        f"{n_line} > 0 AND ((NOT (right(rtrim({bare}), 1) IN ({terminal})) AND {n_line} < {rules.unpunctuated_words})"
        f" OR {hits(_in(SYMBOLS))} * 100 > {n_line} * {rules.line_symbol_percent}"
        f" OR {hits('!')} * 100 > {n_line} * {rules.line_shout_percent}"
        f" OR {hits('[|]')} >= {rules.nav_bars} OR {boiler})"
    )
    return f"""
WITH body AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS body FROM {source}),
parts AS (
  SELECT *, {words.format('body')} AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM body),
good AS (SELECT *, list_filter(lines, lambda x: NOT ({fails})) AS good FROM parts),
win AS (
  SELECT rid, i, array_to_string(words[i:i + {k - 1}], ' ') AS w
  FROM good, unnest(range(1, len(words) - {k - 2})) AS r(i) WHERE len(words) >= {k}),
again AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1),
cover AS (SELECT rid, sum(least({k}, coalesce(nxt - i, {k}))) AS n_repeat_words FROM again GROUP BY rid),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(body) - length(regexp_replace(body, '{_in(SYMBOLS)}', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(good))::BIGINT AS n_removed,
    (len(words) - len({words.format("coalesce(array_to_string(good, chr(10)), '')")}))::BIGINT AS n_lost_words,
    coalesce(array_to_string(good, chr(10)), '') AS clean_text
  FROM good LEFT JOIN cover USING (rid)),
judged AS (
  SELECT *, (n_words < {rules.min_words}
    OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_removed,
  n_lost_words, (NOT base_failed AND 100 * n_lost_words <= {rules.max_lost_percent} * n_words) AS kept
  {{more}}
FROM judged"""


ORACLE_SQL = oracle().replace("{more}", "")
