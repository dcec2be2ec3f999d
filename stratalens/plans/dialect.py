"""The few places where Spark SQL and the oracle's SQL spell one thing differently."""

from __future__ import annotations


class Spark:
    name = "spark"

    def joined(self, x: str, sep: str = ",") -> str:
        """The distinct values of x in order, joined."""
        return f"array_join(array_sort(collect_set({x})), '{sep}')"

    def last(self, x: str) -> str:
        """The last value that isn't null, for an OVER clause."""
        return f"last_value({x}) IGNORE NULLS"

    def hex1(self, x: str) -> str:
        return f"sha1({x})"

    def words(self, x: str) -> str:
        """Rows of (w): the lower-case words of x."""
        return f"LATERAL (SELECT explode(split(lower({x}), '[^a-z0-9]+')) AS w) t"

    def month(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM')"

    def ratio(self, a: str, b: str) -> str:
        return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"

    def at(self, s: str, part: str) -> str:
        return f"instr({s}, {part})"


class Duck(Spark):
    name = "duck"

    def joined(self, x: str, sep: str = ",") -> str:
        return f"coalesce(array_to_string(list_sort(list(DISTINCT {x}) FILTER (WHERE {x} IS NOT NULL)), '{sep}'), '')"

    def last(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS)"

    def words(self, x: str) -> str:
        return f"LATERAL (SELECT unnest(string_split_regex(lower({x}), '[^a-z0-9]+')) AS w) t"

    def month(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m')"
