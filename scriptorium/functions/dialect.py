"""Spellings of the few SQL functions that Spark and DuckDB write differently.

The markup plans are SQL text that is the same for both but for these; so each
plan can be checked against an independent engine.
"""

from __future__ import annotations


class Spark:
    """Spark SQL."""

    name = "spark"

    @staticmethod
    def text(s: str) -> str:
        """A string literal."""
        return "r'" + s + "'" if "\n" not in s and "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(to)})"

    def last(self, x: str) -> str:
        return f"last_value({x}, true)"

    def first(self, x: str) -> str:
        return f"first_value({x}, true)"

    def unnest(self, table: str, keep: str, array: str, pos: str, item: str) -> str:
        """A select of ``keep``, place (from 0) and item of every element of an array."""
        return f"SELECT {keep}, {pos}, {item} FROM {table} LATERAL VIEW posexplode({array}) AS {pos}, {item}"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def joined(self, key: str, x: str, sep: str = "") -> str:
        """Aggregate: texts in the order of a key."""
        return f"array_join(transform(array_sort(collect_list(struct({key} AS k, {x} AS t))), e -> e.t), {self.text(sep)})"

    def lines(self, x: str, item: str) -> str:
        """Lines of a text, each rewritten by an expression of ``l`` and its number ``n`` from 1."""
        return f"array_join(transform(split({x}, '\\n', -1), (l, j) -> {item.replace('{n}', '(j + 1)')}), '\\n')"

    def size(self, x: str) -> str:
        return f"size({x})"

    def bytes(self, x: str) -> str:
        return f"octet_length({x})"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def number(self, x: str) -> str:
        """A BIGINT, null where the text is none."""
        return f"try_cast(nullif({x}, '') AS BIGINT)"

    def sequence(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def array_has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    newline = "'\\n'"
    cr = "'\\r'"
    tab_class = "[ \\t]"


class Duck(Spark):
    """DuckDB SQL."""

    name = "duckdb"

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(to)}, 'g')"

    def last(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS)"

    def first(self, x: str) -> str:
        return f"first_value({x} IGNORE NULLS)"

    def unnest(self, table: str, keep: str, array: str, pos: str, item: str) -> str:
        return f"SELECT {keep}, unnest(range(len(arr_))) AS {pos}, unnest(arr_) AS {item} FROM (SELECT *, {array} AS arr_ FROM {table})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def joined(self, key: str, x: str, sep: str = "") -> str:
        return f"string_agg({x}, {self.text(sep)} ORDER BY {key})"

    def lines(self, x: str, item: str) -> str:
        return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l, j: {item.replace('{n}', 'j')}), chr(10))"

    def size(self, x: str) -> str:
        return f"len({x})"

    def bytes(self, x: str) -> str:
        return f"strlen({x})"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def sequence(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def array_has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    newline = "chr(10)"
    cr = "chr(13)"


SPARK, DUCK = Spark(), Duck()
