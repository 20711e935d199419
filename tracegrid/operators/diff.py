"""Comparing two versions of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.text import BLANK_CLASS, named
from tracegrid.operators.ordered import fill_down as fill
from tracegrid.operators.ordered import union_all

IN_LEFT, IN_RIGHT = "_in_left", "_in_right"


def full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer equi-join as a left join and an anti join.

    Adaptive execution splits a hot key's partition in those but not in a full
    outer join. Null keys match nothing: the left join keeps such rows of the left
    side, the anti join those of the right.
    """
    ours = [f"__k{i}" for i, _ in enumerate(keys)]
    keyed = right.select(*[named(k).alias(o) for k, o in zip(keys, ours)], *[named(c) for c in right.columns if c not in keys])
    matched = left.join(keyed, reduce(Column.__and__, [named(k) == F.col(o) for k, o in zip(keys, ours)]), "left").drop(*ours)
    held = left.select(*[named(k).alias(o) for k, o in zip(keys, ours)])
    alone = right.join(held, reduce(Column.__and__, [named(k) == F.col(o) for k, o in zip(keys, ours)]), "left_anti")
    return union_all([matched, alone])


def _require(df: DataFrame, cols: Sequence[str], what: str) -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")


def table_diff(
    left: DataFrame,
    right: DataFrame,
    mapping: Mapping[str, str],
    keys: Sequence[str],
    fill_down: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Cell-by-cell comparison of two tables on ``keys``.

    ``mapping`` names the right column for each left column. A key held by
    several rows on both sides yields each matching pair, as a join does; null
    keys never match.
    """
    if not keys:
        return row_diff(left, right, mapping)
    _require(left, list(mapping), "left table")
    _require(right, list(mapping.values()), "right table")
    if fill_down:
        wanted = [c for c in fill_down if c in mapping]
        order = list(order_by or [])
        left = fill(left, wanted, order)
        right = fill(right, [mapping[c] for c in wanted], [mapping.get(c, c) for c in order])

    back = {r: l for l, r in mapping.items()}

    def right_name(c: str) -> str:
        name = back.get(c, c)
        return name if name in keys or name not in left.columns else f"{name}_right"

    compared = [c for c in mapping if c not in keys]
    joined = full_outer(
        left.withColumn(IN_LEFT, F.lit(True)),
        right.select(*[named(c).alias(right_name(c)) for c in right.columns]).withColumn(IN_RIGHT, F.lit(True)),
        keys,
    )
    in_left, in_right = (F.coalesce(F.col(c), F.lit(False)) for c in (IN_LEFT, IN_RIGHT))
    both = in_left & in_right
    differs = {c: both & ~named(c).eqNullSafe(named(f"{c}_right")) for c in compared}
    flagged = joined.select(
        *map(named, left.columns),
        *[named(right_name(c)) for c in right.columns if right_name(c) not in left.columns],
        in_left.alias(IN_LEFT),
        in_right.alias(IN_RIGHT),
        *[d.alias(f"_diff_{c}") for c, d in differs.items()],
    )
    changed = F.concat_ws(", ", *[F.when(named(f"_diff_{c}"), F.lit(c)) for c in compared]) if compared else F.lit("")
    status = (
        F.when(F.col(IN_LEFT) & F.col(IN_RIGHT), F.when(F.col("changed_columns") != "", "changed").otherwise("equal"))
        .when(F.col(IN_LEFT), "left_only")
        .otherwise("right_only")
    )
    return flagged.withColumn("changed_columns", changed).withColumn("_merge", status)


def row_diff(left: DataFrame, right: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Whole-row comparison without keys, as counts of equal rows on each side.

    One aggregate over both sides: copies of a row collapse before the shuffle.
    """
    _require(left, list(mapping), "left table")
    _require(right, list(mapping.values()), "right table")
    cols = list(mapping)
    side = left.select(*map(named, cols), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*[named(r).alias(l) for l, r in mapping.items()], F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counted = side.groupBy(*map(named, cols)).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    outcome = F.filter(
        F.array(
            F.struct(F.lit("equal").alias("_merge"), F.least("l", "r").alias("rows")),
            F.struct(F.lit("left_only").alias("_merge"), (F.col("l") - F.col("r")).alias("rows")),
            F.struct(F.lit("right_only").alias("_merge"), (F.col("r") - F.col("l")).alias("rows")),
        ),
        lambda x: x["rows"] > 0,
    )
    return counted.select(*map(named, cols), F.inline(outcome))


def compare_columns(
    old: DataFrame, new: DataFrame, keys: Sequence[str], diff_cols: Sequence[str], hybrid: bool, row_col: str, name_col: str
) -> list[str]:
    """Explicit and (in hybrid mode) shared columns; else the name column; else the first shared."""
    shared = set(old.columns) & set(new.columns) if hybrid else set()
    chosen = (set(diff_cols) | shared) - set(keys) - {row_col}
    if not chosen and shared:
        chosen = {name_col} if name_col in shared else {min(shared)}
    return sorted(chosen)


def hybrid_diff(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    diff_cols: Sequence[str] = (),
    ignore_case: bool = True,
    ignore_ws: bool = True,
    hybrid: bool = True,
    row_col: str = "row_number",
    name_col: str = "SIGNAL_NAME",
) -> DataFrame:
    """Changed, deleted and inserted rows, values compared as text with null as empty."""
    cols = compare_columns(old, new, keys, diff_cols, hybrid, row_col, name_col)
    # Names that differ only in case stay apart as they are.
    low = [c.lower() for c in cols]
    shown = {c: c.lower() if low.count(c.lower()) == 1 else c for c in cols}

    def side(df: DataFrame, tag: str) -> DataFrame:
        def value(c: str) -> Column:
            return named(c) if c in df.columns else F.lit(None).cast("string")

        return df.select(
            *map(named, keys),
            value(row_col).alias(f"{tag}_row_number"),
            *[value(c).alias(f"{tag}__{i}") for i, c in enumerate(cols)],
            F.lit(True).alias(f"__in_{tag}"),
        )

    def norm(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        v = F.lower(v) if ignore_case else v
        return F.regexp_replace(v, BLANK_CLASS + "+", "") if ignore_ws else v

    joined = full_outer(side(old, "old"), side(new, "new"), keys)
    fields = F.concat_ws(", ", *[F.when(norm(f"old__{i}") != norm(f"new__{i}"), F.lit(c)) for i, c in enumerate(cols)])
    in_old, in_new = F.col("__in_old").isNotNull(), F.col("__in_new").isNotNull()
    change = (
        F.when(in_old & in_new & (F.col("changed_fields") != ""), "Modified")
        .when(in_old & ~in_new, "Deleted")
        .when(in_new & ~in_old, "Inserted")
        .otherwise("Unchanged")
    )
    values = [F.col(f"{tag}__{i}").alias(f"{tag}_{shown[c]}") for i, c in enumerate(cols) for tag in ("old", "new")]
    marked = joined.withColumn("changed_fields", fields if cols else F.lit("")).withColumn("change_type", change)
    return marked.where(F.col("change_type") != "Unchanged").select(
        "change_type", *map(named, keys), "old_row_number", "new_row_number", *values, "changed_fields"
    )


def diff_side_by_side(diff: DataFrame, keys: Sequence[str], mapping: Mapping[str, str]) -> DataFrame:
    compared = [c for c in mapping if c not in keys]
    pairs = [p for c in compared for p in (named(c).alias(f"{c}_old"), named(f"{c}_right").alias(f"{c}_new"))]
    return diff.where(F.col("_merge") == "changed").select(*map(named, keys), *pairs)


def diff_cells(diff: DataFrame, keys: Sequence[str], mapping: Mapping[str, str]) -> DataFrame:
    """One row per changed cell, shown as ``old -> new``."""

    def shown(c: str) -> Column:
        return F.coalesce(named(c).cast("string"), F.lit("NULL"))

    cells = [
        F.when(
            named(f"_diff_{c}"),
            F.struct(
                F.lit(c).alias("column_name"),
                F.concat(shown(c), F.lit(" -> "), shown(f"{c}_right")).alias("change"),
            ),
        )
        for c in mapping
        if c not in keys
    ]
    changed = diff.where(F.col("_merge") == "changed")
    return changed.select(*map(named, keys), F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))


def _status_counts(status: str) -> list[Column]:
    names = ("changed", "left_only", "right_only", "equal")
    return [F.count("*").alias("total"), *[F.count_if(F.col(status) == n).alias(n) for n in names]]


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.agg(*_status_counts("_merge"))


def change_type_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change_type").agg(F.count("*").alias("rows"))


def hierarchy_value(diff: DataFrame, c: str) -> Column:
    sides = [named(n).cast("string") for n in (c, f"{c}_right") if n in diff.columns]
    return F.coalesce(*sides, F.lit("N/A"))


def diff_tree_stats(diff: DataFrame, hierarchy_cols: Sequence[str]) -> DataFrame:
    """Status counts for each hierarchy prefix; ``level`` 0 is the root.

    Counts are taken at the leaves first, so only leaf rows are expanded upward.
    """
    names = [f"h{i}" for i, _ in enumerate(hierarchy_cols, 1)]
    leaves = diff.select(*[hierarchy_value(diff, c).alias(n) for c, n in zip(hierarchy_cols, names)], "_merge")
    leaves = leaves.groupBy(*names).agg(*_status_counts("_merge"))
    sums = [F.sum(c).alias(c) for c in ("total", "changed", "left_only", "right_only", "equal")]
    level = (F.lit(len(names)) - F.bit_count(F.grouping_id())).cast("int").alias("level")
    return leaves.rollup(*names).agg(level, *sums)
