"""Comparison queries over the two versions of the orders and lines."""

from tracegrid.checks import check
from tracegrid.fixtures import fixture
from tracegrid.operators import diff as d

MAPPING = {"o_orderkey": "r_key", "o_custkey": "r_cust", "o_orderstatus": "r_status", "o_totalprice": "r_price"}
KEYS = ["o_orderkey"]


def orders_diff(spark, sf):
    return d.table_diff(fixture(spark, sf, "orders_left"), fixture(spark, sf, "orders_right"), MAPPING, KEYS)


def orders_hybrid(spark, sf):
    left = fixture(spark, sf, "orders_left").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey"
    ).withColumnRenamed("o_custkey", "row_number")
    right = fixture(spark, sf, "orders_right").toDF("o_orderkey", "row_number", "o_orderstatus", "o_totalprice")
    return d.hybrid_diff(left, right, KEYS, ["o_orderstatus", "missing_col"])


# The comparison written once in SQL, for the queries that read its result.
DIFF_SQL = """
joined as (
  select coalesce(l.o_orderkey, r.r_key) as o_orderkey, l.o_custkey, l.o_orderstatus, l.o_totalprice,
         l.o_orderpriority, r.r_cust as o_custkey_right, r.r_status as o_orderstatus_right,
         r.r_price as o_totalprice_right, l.o_orderkey is not null as _in_left, r.r_key is not null as _in_right
  from orders_left l full join orders_right r on l.o_orderkey = r.r_key),
flagged as (
  select *, _in_left and _in_right and o_custkey is distinct from o_custkey_right as _diff_o_custkey,
         _in_left and _in_right and o_orderstatus is distinct from o_orderstatus_right as _diff_o_orderstatus,
         _in_left and _in_right and o_totalprice is distinct from o_totalprice_right as _diff_o_totalprice
  from joined),
diffed as (
  select *, concat_ws(', ', case when _diff_o_custkey then 'o_custkey' end,
                            case when _diff_o_orderstatus then 'o_orderstatus' end,
                            case when _diff_o_totalprice then 'o_totalprice' end) as changed_columns,
         case when not _in_right then 'left_only' when not _in_left then 'right_only'
              when _diff_o_custkey or _diff_o_orderstatus or _diff_o_totalprice then 'changed'
              else 'equal' end as _merge
  from flagged)
"""

check("table_diff", f"with {DIFF_SQL} select * from diffed")(orders_diff)


@check(
    "diff_summary",
    f"""with {DIFF_SQL}
select count(*) as total, count(*) filter (where _merge = 'changed') as changed,
       count(*) filter (where _merge = 'left_only') as left_only,
       count(*) filter (where _merge = 'right_only') as right_only,
       count(*) filter (where _merge = 'equal') as equal from diffed""",
)
def _(spark, sf):
    return d.diff_summary(orders_diff(spark, sf))


@check(
    "row_diff",
    """with sides as (
  select l_orderkey, l_linenumber, l_quantity, l_returnflag, 1 as l, 0 as r from lines_left
  union all select r_orderkey, r_linenumber, r_quantity, r_returnflag, 0, 1 from lines_right),
counted as (select l_orderkey, l_linenumber, l_quantity, l_returnflag, sum(l) as l, sum(r) as r
            from sides group by all)
select l_orderkey, l_linenumber, l_quantity, l_returnflag, 'equal' as _merge, cast(least(l, r) as bigint) as rows
from counted where least(l, r) > 0
union all select l_orderkey, l_linenumber, l_quantity, l_returnflag, 'left_only', cast(l - r as bigint) from counted where l > r
union all select l_orderkey, l_linenumber, l_quantity, l_returnflag, 'right_only', cast(r - l as bigint) from counted where r > l""",
)
def _(spark, sf):
    mapping = {"l_orderkey": "r_orderkey", "l_linenumber": "r_linenumber", "l_quantity": "r_quantity", "l_returnflag": "r_returnflag"}
    return d.row_diff(fixture(spark, sf, "lines_left"), fixture(spark, sf, "lines_right"), mapping)


HYBRID_SQL = """
joined as (
  select coalesce(l.o_orderkey, r.r_key) as o_orderkey, l.o_custkey as old_row_number, r.r_cust as new_row_number,
         cast(null as varchar) as old_missing_col, cast(null as varchar) as new_missing_col,
         l.o_orderstatus as old_o_orderstatus, r.r_status as new_o_orderstatus,
         l.o_totalprice as old_o_totalprice, r.r_price as new_o_totalprice,
         l.o_orderkey is not null as in_l, r.r_key is not null as in_r
  from orders_left l full join orders_right r on l.o_orderkey = r.r_key),
flagged as (
  select *, coalesce(old_o_orderstatus, '') <> coalesce(new_o_orderstatus, '') as ds,
         old_o_totalprice is distinct from new_o_totalprice as dp from joined),
hybrid as (
  select case when in_l and in_r then 'Modified' when in_l then 'Deleted' else 'Inserted' end as change_type,
         o_orderkey, old_row_number, new_row_number, old_missing_col, new_missing_col, old_o_orderstatus,
         new_o_orderstatus, old_o_totalprice, new_o_totalprice,
         concat_ws(', ', case when ds then 'o_orderstatus' end, case when dp then 'o_totalprice' end) as changed_fields
  from flagged where not (in_l and in_r) or ds or dp)
"""

check("hybrid_diff", f"with {HYBRID_SQL} select * from hybrid")(orders_hybrid)


@check("change_type_counts", f"with {HYBRID_SQL} select change_type, count(*) as rows from hybrid group by 1")
def _(spark, sf):
    return d.change_type_counts(orders_hybrid(spark, sf))


@check(
    "diff_side_by_side",
    f"""with {DIFF_SQL}
select o_orderkey, o_custkey as o_custkey_old, o_custkey_right as o_custkey_new,
       o_orderstatus as o_orderstatus_old, o_orderstatus_right as o_orderstatus_new,
       o_totalprice as o_totalprice_old, o_totalprice_right as o_totalprice_new
from diffed where _merge = 'changed'""",
)
def _(spark, sf):
    return d.diff_side_by_side(orders_diff(spark, sf), KEYS, MAPPING)


@check(
    "diff_cells",
    f"""with {DIFF_SQL}
select o_orderkey, 'o_orderstatus' as column_name,
       coalesce(o_orderstatus, 'NULL') || ' -> ' || coalesce(o_orderstatus_right, 'NULL') as change
from diffed where _diff_o_orderstatus
union all select o_orderkey, 'o_custkey', coalesce(cast(o_custkey as varchar), 'NULL') || ' -> ' || coalesce(cast(o_custkey_right as varchar), 'NULL')
from diffed where _diff_o_custkey
union all select o_orderkey, 'o_totalprice',
       coalesce(cast(cast(o_totalprice as decimal(18, 2)) as varchar), 'NULL') || ' -> ' || coalesce(cast(cast(o_totalprice_right as decimal(18, 2)) as varchar), 'NULL')
from diffed where _diff_o_totalprice""",
)
def _(spark, sf):
    left, right = fixture(spark, sf, "orders_left"), fixture(spark, sf, "orders_right")
    price = {"o_totalprice": left["o_totalprice"].cast("decimal(18,2)")}
    right_price = {"r_price": right["r_price"].cast("decimal(18,2)")}
    return d.diff_cells(d.table_diff(left.withColumns(price), right.withColumns(right_price), MAPPING, KEYS), KEYS, MAPPING)


@check(
    "diff_tree_stats",
    f"""with {DIFF_SQL},
leaf as (select coalesce(o_orderpriority, 'N/A') as h1, coalesce(o_orderstatus, o_orderstatus_right, 'N/A') as h2, _merge from diffed)
select h1, h2, 2 - (grouping(h1) + grouping(h2)) as level, count(*) as total,
       count(*) filter (where _merge = 'changed') as changed,
       count(*) filter (where _merge = 'left_only') as left_only,
       count(*) filter (where _merge = 'right_only') as right_only,
       count(*) filter (where _merge = 'equal') as equal
from leaf group by rollup(h1, h2)""",
)
def _(spark, sf):
    return d.diff_tree_stats(orders_diff(spark, sf), ["o_orderpriority", "o_orderstatus"])


NAMES = {"o_orderkey": "Sect. No", "o_custkey": "Calc'd", "o_orderstatus": "Rate (ms)", "o_totalprice": "Start Bit + Length - 1"}


def _free_names(spark, sf):
    """Both sides of the orders under header texts as people write them."""
    left = fixture(spark, sf, "orders_left").select(*NAMES).toDF(*NAMES.values())
    return left, fixture(spark, sf, "orders_right").select(*MAPPING.values()).toDF(*NAMES.values())


@check(
    "table_diff_names",
    f"""with {DIFF_SQL}
select o_orderkey as "Sect. No", o_custkey as "Calc'd", o_custkey_right as "Calc'd_right", o_totalprice as "Start Bit + Length - 1",
       replace(replace(replace(changed_columns, 'o_custkey', 'Calc''d'), 'o_orderstatus', 'Rate (ms)'), 'o_totalprice', 'Start Bit + Length - 1') as changed_columns,
       _merge from diffed""",
)
def _(spark, sf):
    left, right = _free_names(spark, sf)
    done = d.table_diff(left, right, {n: n for n in NAMES.values()}, ["Sect. No"])
    return done.select("`Sect. No`", "`Calc'd`", "`Calc'd_right`", "`Start Bit + Length - 1`", "changed_columns", "_merge")


@check(
    "hybrid_diff_names",
    """with joined as (
  select coalesce(l.o_orderkey, r.r_key) as k, l.o_orderstatus as a, r.r_status as b, l.o_orderkey is not null as in_l, r.r_key is not null as in_r
  from orders_left l full join orders_right r on l.o_orderkey = r.r_key)
select k as "Sect. No", case when in_l and in_r then 'Modified' when in_l then 'Deleted' else 'Inserted' end as change_type,
       a as "old_rate (ms)", b as "new_rate (ms)", case when coalesce(a, '') <> coalesce(b, '') then 'Rate (ms)' else '' end as changed_fields
from joined where not (in_l and in_r) or coalesce(a, '') <> coalesce(b, '')""",
)
def _(spark, sf):
    left, right = _free_names(spark, sf)
    done = d.hybrid_diff(left, right, ["Sect. No"], ["Rate (ms)"], hybrid=False)
    return done.select("`Sect. No`", "change_type", "`old_rate (ms)`", "`new_rate (ms)`", "changed_fields")
