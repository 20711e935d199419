"""Fills, row numbers and flat-export ingest over the events and the sparse export."""

from pyspark.sql import functions as F

from tracegrid.checks import check
from tracegrid.checks.text import sql_strip
from tracegrid.fixtures import fixture
from tracegrid.operators import ordered as o
from tracegrid.sources import flat


def _filled(c: str, over: str) -> str:
    return (
        f"last_value(case when {sql_strip(f'cast({c} as varchar)')} <> '' then {c} end ignore nulls) over "
        f"({over} rows between unbounded preceding and current row)"
    )


@check(
    "fill_down",
    f"""select event_id, user_id, {_filled('value', 'order by event_id')} as value,
       {_filled('event_type', 'order by event_id')} as event_type from events_sparse""",
)
def _(spark, sf):
    return o.fill_down(fixture(spark, sf, "events_sparse"), ["value", "event_type", "unknown"], ["event_id"])


@check(
    "fill_down_partitioned",
    f"""select event_id, user_id, {_filled('value', 'partition by user_id order by event_id')} as value,
       {_filled('event_type', 'partition by user_id order by event_id')} as event_type from events_sparse""",
)
def _(spark, sf):
    return o.fill_down(fixture(spark, sf, "events_sparse"), ["value", "event_type"], ["event_id"], ["user_id"])


@check(
    "infer_fill_down",
    f"""with head as (select * from events_sparse),
cells as (select event_id, 'value' as column_name, cast(value as varchar) as v from head
          union all select event_id, 'event_type', event_type from head
          union all select event_id, 'user_id', cast(user_id as varchar) from head)
select column_name, coalesce(min(event_id) filter (where {sql_strip('v')} <> '') < max(event_id) filter (where {sql_strip('v')} = ''), false) as fill_down
from cells group by 1""",
)
def _(spark, sf):
    return o.infer_fill_down(fixture(spark, sf, "events_sparse"), ["value", "event_type", "user_id"], ["event_id"])


@check(
    "global_row_number",
    """select o_orderkey, row_number() over (order by o_orderpriority, o_orderkey) as pos,
       row_number() over (partition by o_orderstatus order by o_orderpriority, o_orderkey) as pos_in_status from orders""",
)
def _(spark, sf):
    df = fixture(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    numbered = o.row_number(df, ["o_orderpriority", "o_orderkey"], "pos")
    numbered = o.row_number(numbered, ["o_orderpriority", "o_orderkey"], "pos_in_status", ["o_orderstatus"])
    return numbered.select("o_orderkey", "pos", "pos_in_status")


def _text_events(spark, sf):
    return fixture(spark, sf, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("user_text"),
        F.format_string("%.2f", "value").alias("value_text"),
        F.when(F.col("event_id") % 100 == 7, "7").otherwise(F.col("event_type")).alias("mixed"),
        "event_type",
    )


EVENT_TEXT = """
t as (select event_id, cast(user_id as varchar) as user_text, value,
             case when event_id % 100 = 7 then '7' else event_type end as mixed, event_type from events)
"""


@check(
    "widen_numeric",
    f"""with {EVENT_TEXT}
select event_id, cast(user_text as double) as user_text, value as value_text, mixed, event_type from t""",
)
def _(spark, sf):
    return flat.widen_numeric(_text_events(spark, sf))[0]


@check(
    "widen_numeric_errors",
    f"""with {EVENT_TEXT}
select 'user_text' as column_name, 0 as cast_errors
union all select 'value_text', 0
union all select 'mixed', count(*) from t where mixed <> '7'""",
)
def _(spark, sf):
    return flat.widen_numeric(_text_events(spark, sf))[1]


@check(
    "ingest_with_carry",
    f"""with n as (select event_id, {_filled('event_type', 'order by event_id')} as signal,
       {_filled('user_id', 'order by event_id')} as owner, value, row_number() over (order by event_id) + 4 as row_number from events_sparse)
select row_number, {sql_strip('signal')} as SIGNAL_NAME, owner as OWNER, value as VALUE from n where {sql_strip('signal')} <> ''""",
)
def _(spark, sf):
    return flat.ingest_with_carry(
        fixture(spark, sf, "events_sparse"),
        {"SIGNAL_NAME": "event_type", "OWNER": "user_id"},
        {"VALUE": "value", "ABSENT": "no_such_column"},
        ["event_id"],
        first_row=5,
    )


@check(
    "distinct_first",
    """select l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_quantity, l_extendedprice from (
  select *, row_number() over (partition by l_suppkey, l_returnflag order by l_orderkey, l_linenumber, l_extendedprice, l_quantity) as rn
  from lineitem) where rn = 1""",
)
def _(spark, sf):
    df = fixture(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    return o.distinct_first(
        df, ["l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    )
