"""Order-sensitive operators that stay parallel: fills, running sums, row numbers.

A window over all rows, or over one very large group, would run in one task.
Instead the ordering is cut into ranges at boundaries that are plain values, so
a row's range depends on its data only and survives a lost executor. Each range
is scanned on its own, and what a range inherits from those before it travels as
one small row per range.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrid.functions.text import blank_to_null, named
from tracegrid.operators.storage import materialize

RANGE = "__range"
# Spark's own range partitioner also samples some twenty keys per output range.
SAMPLE_PER_RANGE = 20


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def assign_ranges(df: DataFrame, order_by: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Add ``__range``: which of about ``ranges`` equal slices of the order a row is in.

    The boundaries come from a sample of bounded size chosen by a hash of the
    key, and each row finds its slice by binary search among them. By default as
    many slices as there are shuffle partitions, fewer where there are fewer keys.
    Several rows whose sampled keys are all one are an error, at any size.
    """
    key = F.struct(*[named(c) for c in order_by])
    keys = df.select(key.alias("key"))
    wanted = ranges or _shuffle_partitions(df)
    # The keys with the smallest hashes: a sample of the same size whatever the input, in one pass.
    drawn = keys.select("key", F.xxhash64("key").alias("h")).orderBy("h").limit(wanted * SAMPLE_PER_RANGE)
    sample = drawn.orderBy("key").select(F.to_json("key", {"ignoreNullFields": "false"}).alias("j")).collect()
    rows = list(dict.fromkeys(r.j for r in sample))
    if len(sample) > 1 and len(rows) == 1:
        raise ValueError(f"{len(sample)} rows or more have one key in {', '.join(order_by)}: the order must be unique")
    step = len(rows) / wanted
    cuts = [rows[math.floor(i * step)] for i in range(1, wanted) if len(rows) > 1]
    cuts = list(dict.fromkeys(cuts))
    if not cuts:
        return df.withColumn(RANGE, F.lit(0))
    schema = T.ArrayType(keys.schema["key"].dataType)
    bounds = F.sort_array(F.from_json(F.lit("[" + ",".join(cuts) + "]"), schema))
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, s: F.when(
            (low + s <= len(cuts)) & (F.get(bounds, low + s - 1) <= key), low + s
        ).otherwise(low),
    )
    return df.withColumn(RANGE, found)


def ordered_scan(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    fills: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add running columns over ``order_by``, restarted for each ``partition_by`` group.

    ``fills``: the last non-null value so far. ``sums``: the running total so far
    (null counts as zero). ``order_by`` must be unique within a group. No group
    is ever handled by one task, however large. The input is read several
    times: keep it first (``materialize``) where it is costly to compute.
    """
    fills, sums = dict(fills or {}), dict(sums or {})
    part, order = list(partition_by), list(order_by)
    names = list(fills) + list(sums)
    raw = {n: f"__raw_{n}" for n in names}
    ready = df.select(
        "*",
        *[e.alias(raw[n]) for n, e in fills.items()],
        *[F.coalesce(e, F.lit(0)).alias(raw[n]) for n, e in sums.items()],
    )
    kept = [named(c) for c in df.columns if c not in names]
    ranged = assign_ranges(ready, part + order, ranges)
    group = F.struct(*[F.col(c) for c in part], F.lit(0).alias("__all"))
    key = F.struct(*[F.col(c) for c in order])
    per_group = ranged.groupBy(RANGE, group.alias("grp")).agg(
        *[F.max_by(named(raw[n]), F.when(named(raw[n]).isNotNull(), key)).alias(n) for n in fills],
        *[F.sum(named(raw[n])).alias(n) for n in sums],
    )
    tails = per_group.groupBy(RANGE).agg(
        F.min("grp").alias("first_grp"),
        F.max("grp").alias("last_grp"),
        F.max_by(F.struct(*[named(n) for n in names]), "grp").alias("tail"),
    )
    # One row per range from here on: at most `ranges` rows, whatever the input.
    within = Window.partitionBy("last_grp").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, 0)
    following = Window.orderBy(RANGE)
    running = tails.select(
        RANGE,
        "first_grp",
        "last_grp",
        *[F.last(F.col("tail")[n], ignorenulls=True).over(within).alias(n) for n in fills],
        *[F.sum(F.col("tail")[n]).over(within).alias(n) for n in sums],
    )
    carry = running.select(
        F.col(RANGE).alias("__carry_range"),
        F.col("first_grp").alias("__first_grp"),
        F.lag("last_grp").over(following).alias("__prev_grp"),
        *[F.lag(named(n)).over(following).alias(f"__carry_{n}") for n in names],
    )

    local = Window.partitionBy(RANGE, *part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = ranged.select(
        *[named(c) for c in ranged.columns if c not in raw.values()],
        *[F.last(named(raw[n]), ignorenulls=True).over(local).alias(f"__local_{n}") for n in fills],
        *[F.sum(named(raw[n])).over(local).alias(f"__local_{n}") for n in sums],
    )
    joined = scanned.join(F.broadcast(carry), F.col(RANGE) == F.col("__carry_range"), "left")
    inherits = group.eqNullSafe(F.col("__first_grp")) & group.eqNullSafe(F.col("__prev_grp"))
    done = {n: F.coalesce(named(f"__local_{n}"), F.when(inherits, named(f"__carry_{n}"))) for n in fills}
    done |= {
        n: named(f"__local_{n}") + F.coalesce(F.when(inherits, named(f"__carry_{n}")), F.lit(0)) for n in sums
    }
    return joined.select(*kept, *[e.alias(n) for n, e in done.items()])


def kept_scan(
    df: DataFrame, order_by: Sequence[str], fills: Mapping[str, Column], place: str, marks: Mapping[str, str] | None = None
) -> DataFrame:
    """``ordered_scan`` over the whole order with one pass over the rows, for results that are kept anyway.

    Returns the columns of ``df`` with those in ``fills`` filled, ``place`` (from 1) and for each filled column in ``marks``
    whether the row has a value of its own. The rows are written once, as their range leaves them; what a range
    inherits is read off the last row of each range and joined in wherever the result is read.
    """
    marks = dict(marks or {})
    rest = [named(c) for c in df.columns if c not in fills]
    raw = {n: f"__raw_{n}" for n in fills}
    ready = df.select("*", *[e.alias(raw[n]) for n, e in fills.items()])
    # A filled column travels only as what it is filled from, unless the order needs it.
    wanted = [c for c in ready.columns if c not in fills or c in order_by]
    ranged = assign_ranges(ready.select(*map(named, wanted)), order_by)
    local = Window.partitionBy(RANGE).orderBy(*map(named, order_by))
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    scanned = ranged.select(
        *rest,
        *[F.last(named(raw[n]), ignorenulls=True).over(so_far).alias(n) for n in fills],
        *[named(raw[n]).isNotNull().alias(m) for n, m in marks.items()],
        RANGE,
        F.row_number().over(local).cast("long").alias("__at"),
    )
    rows = materialize(scanned, "zstd", free=True)
    ends = rows.groupBy(RANGE).agg(F.max("__at").alias("__at"))
    tails = rows.join(F.broadcast(ends), [RANGE, "__at"], "left_semi")
    # One row per range from here on.
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = materialize(
        tails.select(
            F.col(RANGE).alias("__carry_range"),
            F.coalesce(F.sum("__at").over(before), F.lit(0)).alias("__rows_before"),
            *[F.last(named(n), ignorenulls=True).over(before).alias(f"__carry_{n}") for n in fills],
        )
    )
    joined = rows.join(F.broadcast(carry), F.col(RANGE) == F.col("__carry_range"), "left")
    return joined.select(
        *[F.coalesce(named(c), named(f"__carry_{c}")).alias(c) if c in fills else named(c) for c in df.columns],
        # Never null, which a file cannot say of its columns.
        (F.coalesce("__at", F.lit(0)) + F.coalesce("__rows_before", F.lit(0))).alias(place),
        *map(named, marks.values()),
    )


def fill_down(
    df: DataFrame,
    cols: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Blank -> null, then carry the last value forward; unknown columns are ignored."""
    known = [c for c in cols if c in df.columns]
    if not known:
        return df
    done = ordered_scan(df, order_by, partition_by, fills={f"__f_{c}": blank_to_null(c) for c in known}, ranges=ranges)
    return done.select(*[named(f"__f_{c}").alias(c) if c in known else named(c) for c in df.columns])


def infer_fill_down(df: DataFrame, candidates: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per candidate: does a blank follow a value anywhere in the order?

    One aggregate over all rows: the first filled place against the last blank one.
    """
    known = [c for c in dict.fromkeys(candidates) if c in df.columns]
    key = order_value(df, order_by)
    seen = df.agg(
        *[F.min(F.when(blank_to_null(c).isNotNull(), key)).alias(f"v_{i}") for i, c in enumerate(known)],
        *[F.max(F.when(blank_to_null(c).isNull(), key)).alias(f"b_{i}") for i, c in enumerate(known)],
    )
    return seen.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.coalesce(F.col(f"v_{i}") < F.col(f"b_{i}"), F.lit(False)).alias("fill_down"),
                    )
                    for i, c in enumerate(known)
                ]
            )
        )
    )


def fill_columns(df: DataFrame, candidates: Sequence[str], order_by: Sequence[str]) -> list[str]:
    """The inferred columns as a list: one row per column comes to the driver."""
    if not [c for c in candidates if c in df.columns]:
        return []
    rows = infer_fill_down(df, candidates, order_by).where("fill_down").collect()
    return [r.column_name for r in rows]


def row_number(df: DataFrame, order_by: Sequence[str], out: str, partition_by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """1-based position within the whole order, or within each group."""
    return ordered_scan(df, order_by, partition_by, sums={out: F.lit(1).cast("long")}, ranges=ranges)


# Bits of the types whose values are whole numbers.
WHOLE = {"boolean": 1, "tinyint": 8, "smallint": 16, "int": 32, "date": 32, "bigint": 64, "timestamp": 64}
MOST_BITS = 120


def _whole(column: Column, kind: str) -> Column:
    number = {"date": F.unix_date, "timestamp": F.unix_micros, "boolean": lambda c: c.cast("int")}.get(kind, lambda c: c)(column)
    # From 0 up, for null, the smallest.
    return F.coalesce(number.cast("decimal(38,0)") + F.lit(Decimal((1 << WHOLE[kind] - 1) + 1)), F.lit(Decimal(0)))


INTEGERS = ("tinyint", "smallint", "int", "bigint")


def order_spans(df: DataFrame, order_by: Sequence[str]) -> dict[str, tuple[int, int]]:
    """The smallest and the largest value of each order column of whole numbers: one row, from one pass over these columns."""
    whole = [c for c in dict.fromkeys(order_by) if df.schema[c].dataType.simpleString() in INTEGERS]
    if not whole:
        return {}
    ends = df.select(*map(named, whole)).agg(*[f(named(c)).cast("long") for c in whole for f in (F.min, F.max)]).first()
    return {c: (ends[2 * i], ends[2 * i + 1]) for i, c in enumerate(whole) if ends[2 * i] is not None}


def order_value(df: DataFrame, order_by: Sequence[str], spans: Mapping[str, tuple[int, int]] | None = None) -> Column:
    """One value per row that sorts as ``order_by`` does: a number, where the columns hold whole numbers, else a struct.

    Spark aggregates numbers by hash in place; anything wider it sorts. Where ``spans`` says between which
    values every column lies and 63 bits hold them all, it is a long.
    """
    kinds = [df.schema[c].dataType.simpleString() for c in order_by]
    # Places from 1 up, 0 for null, the smallest.
    widths = [(spans[c][1] - spans[c][0] + 1).bit_length() for c in order_by if spans and c in spans]
    if kinds and len(widths) == len(kinds) and all(k in INTEGERS for k in kinds) and sum(widths) <= 63:
        packed = F.lit(0).cast("long")
        for c, width in zip(order_by, widths, strict=True):
            low = F.lit(spans[c][0]).cast("long")
            packed = F.shiftleft(packed, width).bitwiseOR(F.coalesce(named(c).cast("long") - low + F.lit(1).cast("long"), F.lit(0).cast("long")))
        return packed
    if not kinds or any(k not in WHOLE for k in kinds) or sum(WHOLE[k] + 1 for k in kinds) > MOST_BITS:
        return F.struct(*map(named, order_by))
    if len(kinds) == 1 and not df.schema[order_by[0]].nullable:
        return named(order_by[0])
    value = F.lit(Decimal(0))
    for c, k in zip(order_by, kinds, strict=True):
        value = (value * F.lit(Decimal(1 << WHOLE[k] + 1)) + _whole(named(c), k)).cast("decimal(38,0)")
    return value


def distinct_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row per key by the order, which must be unique within a key; a null key is a key of its own.

    The first place per key is an aggregate over keys and places alone, so duplicates
    collapse before the shuffle and a hot key is cheap; then the rows in these places
    are fetched.
    """
    placed = df.withColumn("__place", order_value(df, order_by))
    names = [f"__k{i}" for i, _ in enumerate(keys)]
    firsts = placed.groupBy(*[named(c).alias(n) for c, n in zip(keys, names, strict=True)]).agg(F.min("__place").alias("__first"))
    same = [named(c).eqNullSafe(F.col(n)) for c, n in zip(keys, names, strict=True)]
    return placed.join(firsts, reduce(Column.__and__, same, F.col("__place") == F.col("__first")), "left_semi").drop("__place")


def parts_of_group(
    df: DataFrame, group: Sequence[str], order_by: Sequence[str], size: int, part: str = "part"
) -> DataFrame:
    """Cut each group into numbered parts of at most ``size`` rows in order.

    Lists and texts built per group are built per part, so none grows with the
    largest group; an ordinary group is one part.
    """
    numbered = row_number(df, order_by, "__rn", group)
    return numbered.withColumn(part, F.floor((F.col("__rn") - 1) / size).cast("int") + 1).drop("__rn")


def neighbours(
    df: DataFrame,
    group: Sequence[str],
    order_by: Sequence[str],
    value: Column,
    k_prev: int = 2,
    k_next: int = 2,
    block: int = 4096,
) -> DataFrame:
    """Add ``prev`` (nearest first) and ``next``: the values of the rows around each row.

    Groups are cut into blocks; the few rows at a block's edge are also sent to
    the block next door as context, so the window is never wider than a block.
    """
    numbered = row_number(df, order_by, "__rn", group)
    return around_numbered(numbered, group, value, k_prev, k_next, block).drop("__rn")


def around_numbered(numbered: DataFrame, group: Sequence[str], value: Column, k_prev: int, k_next: int, block: int = 4096) -> DataFrame:
    """Add ``prev`` and ``next`` to rows whose place in their group is known as ``__rn``.

    The values are made where the rows arrive, so they do not travel beside the
    columns they are made of. A negative ``__rn``, different in each row, marks a row
    that has no neighbours and is none.
    """
    block = max(block, k_prev + k_next + 1)
    place = F.col("__rn")
    home = F.when(place > 0, F.floor((place - 1) / block)).otherwise(place)
    low = F.floor((place - 1 - k_next) / block)
    high = F.floor((place - 1 + k_prev) / block)
    targets = F.when(place > 0, F.filter(F.array_distinct(F.array(low, home, high)), lambda b: b >= 0)).otherwise(F.array(home))
    spread = numbered.withColumn("__home", home).withColumn("__block", F.explode(targets))
    moved = spread.repartition(*map(named, group), "__block").withColumn("__value", value)
    w = Window.partitionBy(*map(named, group), "__block").orderBy("__rn")
    empty = F.array().cast(T.ArrayType(moved.schema["__value"].dataType))
    before = F.reverse(F.collect_list("__value").over(w.rowsBetween(-k_prev, -1))) if k_prev > 0 else empty
    after = F.collect_list("__value").over(w.rowsBetween(1, k_next)) if k_next > 0 else empty
    return (
        moved.withColumn("prev", before)
        .withColumn("next", after)
        .where(F.col("__block") == F.col("__home"))
        .drop("__value", "__home", "__block")
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
