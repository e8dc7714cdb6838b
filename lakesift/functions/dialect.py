"""SQL in two dialects from one text: Spark SQL for the engine, DuckDB for the oracle.

Queries are written once as SQL with marks: @table@ for a table, and calls of a Dialect where functions differ.
Regular expressions are written in RE2's syntax; Spark gets them translated to Java's, with the same meaning.
"""

from __future__ import annotations

import re


def java_regex(pattern: str) -> str:
    """An RE2 pattern for Java: ASCII word boundaries, RE2's white space and end of text, Unicode folding."""
    word = "[0-9A-Za-z_]"
    out = pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")
    out = re.sub(r"\\s", r"[\\t\\n\\f\\r ]", re.sub(r"\[([^\]]*)\\s([^\]]*)\]", r"[\1\\t\\n\\f\\r \2]", out))
    out = re.sub(r"(?<!\\)\$(?=\)|\||$)", r"\\z", out)
    return "(?ud)" + out


class Dialect:
    """Spark's side; DuckDB below."""

    name = "spark"

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def __init__(self, sf_dir: str = ""):
        self.sf_dir = sf_dir

    def text(self, s: str) -> str:
        # A dollar sign is written as its code, as Spark puts variables in place of ${...} in SQL text.
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"

    def regex(self, p: str) -> str:
        return self.text(java_regex(p))

    def hit(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.regex(p)})"

    def find(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.regex(p)}, {group})"

    def find_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.regex(p)}, 0)"

    def swap(self, x: str, p: str, to: str) -> str:
        """to: with $1 for groups and no other dollar."""
        return f"regexp_replace({x}, {self.regex(p)}, {self.text(to)})"

    def pieces(self, x: str, sep: str) -> str:
        return f"split({x}, {self.text(re.escape(sep) if sep != chr(10) else sep)}, -1)"

    def rows(self, array: str, value: str, pos: str, source: str) -> str:
        """source with each element of an array and its place from 0."""
        # OUTER: else Spark tests the array's size below the explode, with every expression of the array once more.
        return f"(SELECT * FROM {source} LATERAL VIEW OUTER posexplode({array}) lv AS {pos}, {value} WHERE {pos} IS NOT NULL)"

    def values(self, rows: list[tuple], columns: list[str]) -> str:
        def one(v):
            if v is None:
                return "CAST(NULL AS STRING)" if self.name == "spark" else "CAST(NULL AS VARCHAR)"
            if isinstance(v, bool):
                return str(v).upper()
            return str(v) if isinstance(v, int) else self.text(v)

        body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
        return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(columns)}))"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def size(self, x: str) -> str:
        return f"octet_length({x})"

    def lambda_(self, fn: str, array: str, var: str, body: str) -> str:
        return f"{fn}({array}, {var} -> {body})"

    def joined(self, value: str, order: str) -> str:
        """The values of a group in order, one after the other."""
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), s -> s.v), '')"

    def joined_by(self, value: str, sep: str) -> str:
        """The distinct values of a group, sorted."""
        return f"array_join(array_sort(collect_set({value})), '{sep}')"

    def sorted_text(self, array: str) -> str:
        return f"array_join(array_sort(array_distinct({array})), ',')"

    def length(self, array: str) -> str:
        return f"CAST(size({array}) AS BIGINT)"

    def item(self, array: str, i: str) -> str:
        return f"get({array}, {i})"

    def part(self, array: str, first: int, last: int) -> str:
        return f"slice({array}, {first}, {last - first + 1})"

    def distance(self, a: str, b: str) -> str:
        return f"levenshtein({a}, {b})"

    def anybit(self, x: str) -> str:
        return f"coalesce(bool_or({x}), FALSE)"

    def unhex(self, x: str) -> str:
        return f"unhex({x})"


class Duck(Dialect):
    name = "duckdb"

    def table(self, name: str) -> str:
        return name

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\x1b", "' || chr(27) || '") + "'"

    def regex(self, p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    def hit(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.regex(p)})"

    def find_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.regex(p)})"

    def swap(self, x: str, p: str, to: str) -> str:
        return f"regexp_replace({x}, {self.regex(p)}, '{re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], to)}', 'g')"

    def pieces(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.text(sep)})"

    def rows(self, array: str, value: str, pos: str, source: str) -> str:
        return f"(SELECT *, generate_subscripts({array}, 1) - 1 AS {pos}, unnest({array}) AS {value} FROM {source})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def size(self, x: str) -> str:
        return f"strlen({x})"

    def lambda_(self, fn: str, array: str, var: str, body: str) -> str:
        fn = {"transform": "list_transform", "filter": "list_filter"}.get(fn, fn)
        if fn == "exists":
            return f"(len(list_filter({array}, lambda {var}: {body})) > 0)"
        return f"{fn}({array}, lambda {var}: {body})"

    def joined(self, value: str, order: str) -> str:
        return f"string_agg({value}, '' ORDER BY {order})"

    def joined_by(self, value: str, sep: str) -> str:
        return f"coalesce(array_to_string(list_sort(list_distinct(list({value}))), '{sep}'), '')"

    def sorted_text(self, array: str) -> str:
        return f"array_to_string(list_sort(list_distinct({array})), ',')"

    def length(self, array: str) -> str:
        return f"CAST(len({array}) AS BIGINT)"

    def item(self, array: str, i: str) -> str:
        return f"({array})[({i}) + 1]"

    def part(self, array: str, first: int, last: int) -> str:
        return f"({array})[{first}:{last}]"
