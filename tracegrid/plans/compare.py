"""Two files to their comparison and its reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrid.functions.text import named, py_strip
from tracegrid.operators import diff as d
from tracegrid.operators.ordered import fill_down as fill
from tracegrid.operators.ordered import union_all
from tracegrid.operators.storage import materialize
from tracegrid.sources.flat import read_flat, widen_numeric
from tracegrid.sources.sinks import write_grouped_json


POSITION = "__position"


def _as_numbers(df: DataFrame, wide: set[str]) -> DataFrame:
    texts = {c for c, t in df.dtypes if t == "string"}
    return df.select(*[py_strip(c).try_cast("double").alias(c) if c in wide & texts else named(c) for c in df.columns])


@dataclass(frozen=True)
class Comparison:
    """The compared rows, kept once, and the views over them."""

    rows: DataFrame
    keys: list[str]
    mapping: dict[str, str]
    hierarchy: list[str]
    # What kept text columns with numbers from being numbers: ``side``, ``column_name``, ``cast_errors``.
    casts: DataFrame

    def summary(self) -> DataFrame:
        return d.diff_summary(self.rows)

    def tree(self) -> DataFrame:
        return d.diff_tree_stats(self.rows, self.hierarchy)

    def side_by_side(self) -> DataFrame:
        return d.diff_side_by_side(self.rows, self.keys, self.mapping)

    def cells(self) -> DataFrame:
        return d.diff_cells(self.rows, self.keys, self.mapping)

    def write_json(self, path: str, level: int = 1) -> None:
        columns = [*self.keys, *[c for c in self.mapping if c not in self.keys]]
        write_grouped_json(self.rows, self.hierarchy, level, columns, path)


def _in_order(df: DataFrame, columns: Sequence[str], numbers: set[str]) -> tuple[DataFrame, list[str]]:
    """The rows with hidden columns that sort them: a text column of numbers by number, then by its text."""
    order = {}
    for i, c in enumerate(columns):
        if c in numbers and df.schema[c].dataType == T.StringType():
            order[f"__n{i}"] = py_strip(c).try_cast("double")
        order[f"__o{i}"] = named(c)
    return df.select("*", *[e.alias(n) for n, e in order.items()]), list(order)


def diff_and_report(
    left: DataFrame,
    right: DataFrame,
    mapping: Mapping[str, str],
    keys: Sequence[str],
    order_by: Sequence[str],
    fill_down: Sequence[str] = (),
    hierarchy: Sequence[str] = (),
    numeric: bool = True,
    right_order: Sequence[str] | None = None,
) -> Comparison:
    """Type, fill and compare two flat tables.

    ``order_by`` names the left row order, ``right_order`` the right one (else the
    columns mapped to the left's). A text column that holds numbers and nothing else
    sorts as numbers.
    """
    right_order = list(right_order or [mapping.get(c, c) for c in order_by])
    (wide_left, casts_left), (wide_right, casts_right) = widen_numeric(left), widen_numeric(right)
    numbers_left, numbers_right = ({c for c, t in w.dtypes if t == "double"} for w in (wide_left, wide_right))
    if fill_down:
        wanted = [c for c in fill_down if c in mapping]
        columns = left.columns, right.columns
        left, order = _in_order(left, list(order_by), numbers_left)
        left = fill(left, wanted, order).select(*map(named, columns[0]))
        right, order = _in_order(right, right_order, numbers_right)
        right = fill(right, [mapping[c] for c in wanted], order).select(*map(named, columns[1]))
    if numeric:
        # A column is compared as a number only where both sides hold nothing but numbers.
        both = {c: r for c, r in mapping.items() if c in numbers_left and r in numbers_right}
        left = _as_numbers(left, set(both))
        right = _as_numbers(right, set(both.values()))
    rows = d.table_diff(left, right, mapping, keys)
    sides = [c.select(F.lit(side).alias("side"), "column_name", "cast_errors") for side, c in (("left", casts_left), ("right", casts_right))]
    return Comparison(materialize(rows), list(keys), dict(mapping), list(hierarchy), union_all(sides))


def compare_files(
    spark: SparkSession,
    left: str,
    right: str,
    mapping: Mapping[str, str],
    keys: Sequence[str],
    fill_down: Sequence[str] = (),
    hierarchy: Sequence[str] = (),
    numeric: bool = True,
    header_row: int = 1,
) -> Comparison:
    """The comparison of two flat files or folders, whose order is that of their records."""
    sides = [materialize(read_flat(spark, path, header_row, position=POSITION)) for path in (left, right)]
    wide = [*mapping, *keys], [*mapping.values(), *[mapping.get(k, k) for k in keys]]
    read = [df.select(POSITION, *[named(c) for c in df.columns if c in set(names)]) for df, names in zip(sides, wide, strict=True)]
    found = diff_and_report(*read, mapping, keys, [POSITION], fill_down, hierarchy, numeric, [POSITION])
    return replace(found, rows=found.rows.drop(POSITION, f"{POSITION}_right"))
