"""Hierarchical tables from the sparse export."""

import uuid

from pyspark.sql import functions as F

from tracegrid.checks import check
from tracegrid.checks.ordered import _filled
from tracegrid.fixtures import fixture
from tracegrid.operators import hierarchy as h
from tracegrid.operators.hierarchy_columns import KEYS
from tracegrid.operators.storage import materialize, shared_folder
from tracegrid.sources.sinks import write_normalized

ORDER = ["reg", "nat", "sup", "ord", "line"]

MAPPING = {
    "system": {"System_LOID": "sys_id", "System_Name": "sys_name"},
    "physport": {"PhysicalPort_LOID": "phys_id", "System_LOID": "sys_id", "PhysicalPort_Name": "phys_name"},
    "outputport": {"OutputPort_LOID": "out_id", "PhysicalPort_LOID": "phys_id", "OutputPort_Name": "out_name"},
    "wordstring": {
        "Wordstring_LOID": "ws_id",
        "OutputPort_LOID": "out_id",
        "Wordstring_Name": "ws_name",
        "Wordstring_Mnemonic": "ws_name",
    },
    "word": {"Wordstring_LOID": "ws_id", "Word_Seq_Num": "seq", "Word_Bit_Length": "bits"},
    "parameter": {
        "Parameter_LOID": "par_id",
        "OutputPort_LOID": "out_id",
        "Parameter_Name": "par_name",
        "Parameter_Mnemonic": "par_name",
    },
    "report": {"Database_DateTime": "stamp"},
}

OVER = "order by reg, nat, sup, ord, line"
FILLED = ", ".join(
    f"{_filled(c, OVER)} as {c}"
    for c in "sys_id sys_name phys_id phys_name out_id out_name ws_id ws_name seq bits par_id par_name".split()
)


def _first(name: str, key: str, cols: str) -> str:
    return (
        f"{name} as (select {cols} from (select *, row_number() over (partition by {key} {OVER}) as rn from filled) where rn = 1)"
    )


# The tables written once in SQL, for the queries that read them.
TABLES_SQL = f"""
filled as (select reg, nat, sup, ord, line, {FILLED} from flat_export),
{_first('t_system', 'sys_id', 'sys_id, sys_name')},
{_first('t_physport', 'phys_id', 'phys_id, sys_id, phys_name')},
{_first('t_outputport', 'out_id', 'out_id, phys_id, out_name')},
{_first('t_wordstring', 'ws_id', 'ws_id, out_id, ws_name')},
{_first('t_word', 'ws_id, seq', 'ws_id, seq, bits')},
{_first('t_parameter', 'par_id', 'par_id, out_id, par_name')}
"""


def normalized(spark, sf):
    # Kept as a table first: it stands for an export that was read from a file.
    return h.normalize_tables(materialize(fixture(spark, sf, "flat_export"), "zstd", free=True), ORDER, MAPPING)


def one_list(tables):
    """All tables as (table, key, parent, name) rows."""

    def rows(name, key, parent, label):
        return tables[name].select(
            F.lit(name).alias("table_name"), F.col(key).alias("key"), parent.alias("parent"), label.alias("name")
        )

    none = F.lit(None).cast("string")
    return (
        rows("system", "System_LOID", none, F.col("System_Name"))
        .unionByName(rows("physport", "PhysicalPort_LOID", F.col("System_LOID"), F.col("PhysicalPort_Name")))
        .unionByName(rows("outputport", "OutputPort_LOID", F.col("PhysicalPort_LOID"), F.col("OutputPort_Name")))
        .unionByName(rows("wordstring", "Wordstring_LOID", F.col("OutputPort_LOID"), F.col("Wordstring_Name")))
        .unionByName(
            rows("word", "Wordstring_LOID", F.col("Word_Seq_Num").cast("string"), F.col("Word_Bit_Length").cast("string"))
        )
        .unionByName(rows("parameter", "Parameter_LOID", F.col("OutputPort_LOID"), F.col("Parameter_Name")))
    )


def sql_list(where: dict[str, str] | None = None) -> str:
    w = {k: f"where {v}" for k, v in (where or {}).items()}
    return f"""
select 'system' as table_name, sys_id as key, cast(null as varchar) as parent, sys_name as name from t_system {w.get('system', '')}
union all select 'physport', phys_id, sys_id, phys_name from t_physport {w.get('physport', '')}
union all select 'outputport', out_id, phys_id, out_name from t_outputport {w.get('outputport', '')}
union all select 'wordstring', ws_id, out_id, ws_name from t_wordstring {w.get('wordstring', '')}
union all select 'word', ws_id, cast(seq as varchar), cast(bits as varchar) from t_word {w.get('word', '')}
union all select 'parameter', par_id, out_id, par_name from t_parameter {w.get('parameter', '')}"""


@check("normalize_tables", f"with {TABLES_SQL} {sql_list()}")
def _(spark, sf):
    return one_list(normalized(spark, sf).tables)


@check(
    "write_normalized_tables",
    f"with {TABLES_SQL}, l as ({sql_list()}) select 'parquet' as format, * from l union all select 'csv', * from l",
)
def _(spark, sf):
    """Every table written and read again, as Parquet and as CSV."""
    done = normalized(spark, sf)
    path = f"{shared_folder(spark).rstrip('/')}/tracegrid/{uuid.uuid4().hex}"
    tables, lists = done.tables, []
    for fmt in ("parquet", "csv"):
        write_normalized(tables, done.flat, f"{path}/{fmt}", fmt, compression="gzip" if fmt == "csv" else None)
        reader = spark.read.format(fmt).options(**({"header": True, "escape": '"'} if fmt == "csv" else {}))
        back = {n: reader.schema(df.schema).load(f"{path}/{fmt}/{n}") for n, df in tables.items() if df.columns}
        lists.append(one_list(back).select(F.lit(fmt).alias("format"), "*"))
        # The tables are worked out once: what was written first stands for them, sorted by key as they are.
        tables = {n: df.orderBy(*KEYS[n]) if KEYS.get(n) else df for n, df in back.items()}
    return lists[0].unionByName(lists[1])


@check(
    "normalization_report",
    f"""with {TABLES_SQL}
select 'rows:raw' as item, count(*) as rows from flat_export union all select 'rows:system', count(*) from t_system
union all select 'rows:physport', count(*) from t_physport union all select 'rows:outputport', count(*) from t_outputport
union all select 'rows:wordstring', count(*) from t_wordstring union all select 'rows:word', count(*) from t_word
union all select 'rows:parameter', count(*) from t_parameter
union all select 'cleaned_columns', 17 union all select 'filled_columns', 12 union all select 'inferred_columns', 8""",
)
def _(spark, sf):
    return normalized(spark, sf).report().select("item", "rows")


CASCADE = {
    "system": "sys_id = 'S1'",
    "physport": "sys_id = 'S1'",
    "outputport": "phys_id in (select phys_id from t_physport where sys_id = 'S1')",
    "wordstring": "out_id in (select out_id from t_outputport where phys_id in (select phys_id from t_physport where sys_id = 'S1')) and ws_name like '%1%'",
    "word": "ws_id in (select ws_id from t_wordstring where out_id in (select out_id from t_outputport where phys_id in (select phys_id from t_physport where sys_id = 'S1')) and ws_name like '%1%')",
    "parameter": "out_id in (select out_id from t_outputport where phys_id in (select phys_id from t_physport where sys_id = 'S1')) and par_name like '%1%'",
}


@check("cascade_filter", f"with {TABLES_SQL} {sql_list(CASCADE)}")
def _(spark, sf):
    return one_list(h.cascade_filter(normalized(spark, sf).tables, system="S1", text="1"))


@check(
    "cascade_options",
    f"""with {TABLES_SQL},
outs as (select * from t_outputport where phys_id in (select phys_id from t_physport where sys_id = 'S2'))
select 'system' as level, sys_id as key, coalesce(sys_name, sys_id) as label from t_system
union all select 'physport', phys_id, coalesce(phys_name, phys_id) from t_physport where sys_id = 'S2'
union all select 'outputport', out_id, out_name from outs
union all select 'wordstring', ws_id, ws_name || ' | ' || ws_name from t_wordstring where out_id in (select out_id from outs)""",
)
def _(spark, sf):
    return h.cascade_options(normalized(spark, sf).tables, system="S2")


@check(
    "text_search",
    "select s_suppkey, s_name from supplier where contains(lower(s_name), 'r#00') or contains(cast(s_suppkey as varchar), 'r#00')",
)
def _(spark, sf):
    return h.text_search(fixture(spark, sf, "supplier"), ["s_name", "s_suppkey"], "R#00").select("s_suppkey", "s_name")


INDEX_SQL = f"""{TABLES_SQL},
idx as (
  select w.ws_id, w.out_id, o.phys_id, p.sys_id, w.ws_name, o.out_name, p.phys_name, s.sys_name,
         (select count(*) from t_word x where x.ws_id = w.ws_id) as word_count,
         (select count(*) from t_parameter x where x.out_id = w.out_id) as parameter_count
  from t_wordstring w left join t_outputport o on w.out_id = o.out_id left join t_physport p on o.phys_id = p.phys_id
       left join t_system s on p.sys_id = s.sys_id)"""


@check(
    "hierarchy_index",
    f"""with {INDEX_SQL}
select sys_id as System_LOID, phys_id as PhysicalPort_LOID, out_id as OutputPort_LOID, ws_id as Wordstring_LOID,
       ws_name as Wordstring_Name, ws_name as Wordstring_Mnemonic, out_name as OutputPort_Name, phys_name as PhysicalPort_Name,
       sys_name as System_Name, word_count, parameter_count from idx""",
)
def _(spark, sf):
    return h.hierarchy_index(normalized(spark, sf).tables)


@check(
    "hierarchy_rollup",
    f"""with {INDEX_SQL}
select 3 - (grouping(sys_id) + grouping(phys_id) + grouping(out_id)) as level, sys_id as System_LOID,
       phys_id as PhysicalPort_LOID, out_id as OutputPort_LOID,
       case 3 - (grouping(sys_id) + grouping(phys_id) + grouping(out_id)) when 1 then min(sys_name) when 2 then min(phys_name) else min(out_name) end as label,
       count(*) as wordstrings, cast(sum(word_count) as bigint) as words, cast(sum(parameter_count) as bigint) as parameters
from idx group by grouping sets ((sys_id), (sys_id, phys_id), (sys_id, phys_id, out_id))""",
)
def _(spark, sf):
    return h.hierarchy_rollup(h.hierarchy_index(normalized(spark, sf).tables))


@check(
    "table_counts",
    f"""with {TABLES_SQL}, l as ({sql_list(CASCADE)})
select table_name, count(*) as rows from l group by 1""",
)
def _(spark, sf):
    return h.table_counts(h.cascade_filter(normalized(spark, sf).tables, system="S1", text="1"))
