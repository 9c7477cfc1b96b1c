"""A plan is a list of named subqueries written in common SQL; what differs
between engines goes through a dialect. Spark runs the plan (Catalyst sees one
query); the same plan can be printed for another engine to check against."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Spark:
    """Spark SQL; tables are DataFrames handed to the query."""

    name = "spark"

    def table(self, name: str) -> str:
        return "{" + name + "}"

    def dealt(self, name: str, key: str) -> str:
        """The table's rows dealt by the key, so that groupings by more keys and by the key alone deal nothing again."""
        return f"(SELECT /*+ REPARTITION({key}) */ * FROM {self.table(name)})"

    def part_dealt(self, name: str, key: str) -> str:
        """As ``dealt``, of an earlier part's rows."""
        return f"(SELECT /*+ REPARTITION({key}) */ * FROM {name})"

    def days(self, later: str, earlier: str) -> str:
        return f"CAST(datediff({later}, {earlier}) AS BIGINT)"

    def sides(self, column: str) -> str:
        return f"LATERAL VIEW explode(array(0, 1)) sides AS {column}"

    def each(self, items: list[str], column: str) -> str:
        return f"LATERAL VIEW explode(array({', '.join(items)})) each_{column} AS {column}"

    def pack(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def percentile(self, value: str, q: float) -> str:
        return f"percentile({value}, {q})"

    def try_int(self, text: str) -> str:
        return f"try_cast({text} AS INT)"

    def contains(self, text: str, part: str) -> str:
        return f"contains({text}, {part})"

    def shifted_years(self, day: str, years: int) -> str:
        return f"add_months({day}, {12 * years})"

    def joined(self, value: str, sep: str, order: str) -> str:
        return f"array_join(transform(array_sort(collect_list(named_struct('o', {order}, 'v', {value}))), x -> x.v), '{sep}')"

    def regex(self, text: str, pattern: str, group: int) -> str:
        return f"regexp_extract({text}, r'{pattern}', {group})"

    def replaced(self, text: str, pattern: str, new: str) -> str:
        return f"regexp_replace({text}, r'{pattern}', '{new}')"

    def matches(self, text: str, pattern: str) -> str:
        return f"({text} RLIKE r'{pattern}')"

    def sha256(self, text: str) -> str:
        return f"sha2({text}, 256)"

    def parsed_date(self, text: str, spark: str, duck: str) -> str:
        return f"CAST(try_to_timestamp({text}, '{spark}') AS DATE)"


class Duck:
    """DuckDB SQL; tables are views of the same names."""

    name = "duck"

    def table(self, name: str) -> str:
        return name

    def dealt(self, name: str, key: str) -> str:
        return self.table(name)

    def part_dealt(self, name: str, key: str) -> str:
        return name

    def days(self, later: str, earlier: str) -> str:
        return f"date_diff('day', {earlier}, {later})"

    def sides(self, column: str) -> str:
        return f", (VALUES (0), (1)) sides({column})"

    def each(self, items: list[str], column: str) -> str:
        return f", unnest([{', '.join(items)}]) each_{column}({column})"

    def pack(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def percentile(self, value: str, q: float) -> str:
        return f"quantile_cont({value}, {q})"

    def try_int(self, text: str) -> str:
        return f"try_cast({text} AS INTEGER)"

    def contains(self, text: str, part: str) -> str:
        return f"contains({text}, {part})"

    def shifted_years(self, day: str, years: int) -> str:
        return f"CAST({day} + INTERVAL ({years}) YEAR AS DATE)"

    def joined(self, value: str, sep: str, order: str) -> str:
        return f"string_agg({value}, '{sep}' ORDER BY {order})"

    def regex(self, text: str, pattern: str, group: int) -> str:
        return f"regexp_extract({text}, '{self._quoted(pattern)}', {group})"

    def replaced(self, text: str, pattern: str, new: str) -> str:
        return f"regexp_replace({text}, '{self._quoted(pattern)}', '{new}', 'g')"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{self._quoted(pattern)}')"

    def sha256(self, text: str) -> str:
        return f"sha256({text})"

    def parsed_date(self, text: str, spark: str, duck: str) -> str:
        return f"CAST(try_strptime({text}, '{duck}') AS DATE)"

    @staticmethod
    def _quoted(pattern: str) -> str:
        return pattern.replace("'", "''")


Dialect = Spark | Duck
Part = tuple[str, Callable[[Dialect], str]]


@dataclass(frozen=True)
class Plan:
    """Named parts in order; the last is the result."""

    parts: tuple[Part, ...]

    def then(self, *more: Part) -> Plan:
        return Plan(self.parts + more)

    def text(self, dialect: Dialect) -> str:
        *inner, (_, last) = self.parts
        head = ",\n".join(f"{name} AS (\n{sql(dialect)}\n)" for name, sql in inner)
        return (f"WITH {head}\n" if head else "") + last(dialect)

    def run(self, spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
        text = self.text(Spark())
        return spark.sql(text, **{k: v for k, v in tables.items() if "{" + k + "}" in text})


def difference(sql: str, digits: int) -> str:
    """A rounded difference without a negative zero."""
    r = f"round({sql}, {digits})"
    return f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END"


def columns(*items: str | Iterable[str]) -> str:
    """A select list from single columns and lists of them."""
    flat: list[str] = []
    for i in items:
        flat += [i] if isinstance(i, str) else list(i)
    return ",\n  ".join(flat)
