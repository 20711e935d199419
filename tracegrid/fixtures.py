"""Inputs derived from the base tables, as SQL both engines read the same way."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

FIXTURES: dict[str, str] = {}

FIXTURES["orders_left"] = """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders
"""

# Every order is on both sides; some keys are renumbered, so they have no partner.
FIXTURES["orders_right"] = """
select case when o_orderkey % 50 = 8 then -o_orderkey else o_orderkey end as r_key,
       o_custkey as r_cust,
       case when o_orderkey % 17 = 0 then null else o_orderstatus end as r_status,
       case when o_orderkey % 10 = 3 then o_totalprice + 1 else o_totalprice end as r_price
from orders
"""

FIXTURES["lines_left"] = """
select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem
"""

FIXTURES["lines_right"] = """
select case when l_orderkey % 50 = 8 then -l_orderkey else l_orderkey end as r_orderkey,
       l_linenumber as r_linenumber, l_quantity as r_quantity, l_returnflag as r_returnflag
from lineitem
"""

FIXTURES["events_sparse"] = """
select event_id, user_id,
       case when event_id % 3 = 0 then value else null end as value,
       case when event_id % 5 = 0 then event_type when event_id % 5 = 1 then ''
            when event_id % 5 = 2 then '  ' else null end as event_type
from events
"""


# A wide sparse export: the ids and names above a wordstring stand on a supplier's first row only.
FIXTURES["flat_rows"] = """
select n_regionkey as reg, s_nationkey as nat, l_suppkey as sup, l_orderkey as ord, l_linenumber as line,
       min(l_partkey) as pk, min(l_quantity) as qty, min(r_name) as r_name, min(n_name) as n_name, min(s_name) as s_name
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
     join region on n_regionkey = r_regionkey
group by n_regionkey, s_nationkey, l_suppkey, l_orderkey, l_linenumber
"""

FIXTURES["flat_marked"] = """
select r.*, case when r.ord * 100 + r.line = s.first_line then 1 else 0 end as new_sup,
       case when r.line = w.first_word then 1 else 0 end as new_ws
from flat_rows r
     join (select sup as s_sup, min(ord * 100 + line) as first_line from flat_rows group by sup) s on r.sup = s.s_sup
     join (select sup as w_sup, ord as w_ord, min(line) as first_word from flat_rows group by sup, ord) w
       on r.sup = w.w_sup and r.ord = w.w_ord
"""

FIXTURES["flat_export"] = """
select reg, nat, sup, ord, line,
       case when new_sup = 1 then concat('S', cast(reg as varchar(20))) end as sys_id,
       case when new_sup = 1 then r_name end as sys_name,
       case when new_sup = 1 then concat('P', cast(nat as varchar(20))) end as phys_id,
       case when new_sup = 1 then n_name end as phys_name,
       case when new_sup = 1 then concat('O', cast(sup as varchar(20))) else '  ' end as out_id,
       case when new_sup = 1 then s_name else '' end as out_name,
       case when new_ws = 1 then concat('W', cast(ord as varchar(20)), '-', cast(sup as varchar(20))) end as ws_id,
       case when new_ws = 1 then concat('String ', cast(ord as varchar(20))) end as ws_name,
       line as seq, cast(qty as int) as bits,
       concat('A', cast(pk as varchar(20)), '-', cast(sup as varchar(20))) as par_id,
       concat('Param ', cast(pk % 50 as varchar(20))) as par_name
from flat_marked
"""

FIXTURES["req_base"] = """
select doc_id as d, doc_id % 4 as dm, cast(floor(doc_id / 4) as int) as q, text, lang, source,
       case when doc_id % 37 = 5 and doc_id >= 8 then doc_id - 4 else doc_id end as rid,
       concat(cast(cast(floor(floor(doc_id / 4) / 64) as int) + 1 as varchar(20)), '.',
              cast(cast(floor(floor(doc_id / 4) / 8) as int) % 8 + 1 as varchar(20))) as sec
from documents
"""

# Raw requirement rows: section headers, requirements, and rows with missing cells.
FIXTURES["req_rows"] = """
select concat('D', cast(dm as varchar(20))) as doc_name, d,
       case when q % 8 = 0 then '' when d % 37 = 5 then ' '
            when d % 11 = 0 then concat('req-', cast(d as varchar(20)), '; alt-', cast(d + 1 as varchar(20)))
            else concat('REQ-', cast(d as varchar(20))) end as req,
       case when q % 64 = 32 then null when q % 8 = 0 then sec when d % 41 = 6 then ''
            else concat(sec, '-', cast(q % 8 as varchar(20))) end as num,
       case when q % 8 = 0 then concat('Area ', sec) else replace(text, chr(10), ' ') end as body,
       case when q % 8 = 0 then 'Heading' when d % 5 = 0 then 'Requirement' when d % 5 = 1 then '' end as kind,
       case when d % 3 = 0 and d >= 8 then concat('REQ-', cast(d - 4 as varchar(20)), ', req-', cast(d - 8 as varchar(20))) end as up,
       case when d % 6 = 0 and d >= 8 then concat('REQ-', cast(d - 4 as varchar(20))) else '' end as up2,
       case when dm = 1 then concat('REQ-', cast(d + 4 as varchar(20))) end as down,
       case when d % 2 = 0 then lang end as safety
from req_base
"""

# Normalised requirements, written directly so that views over them have their own input. Some ids repeat.
FIXTURES["reqs"] = """
select d as row_idx,
       concat('REQ-', case when rid < 10000 then lpad(cast(rid as varchar(20)), 5, '0') else cast(rid as varchar(20)) end) as Req_ID,
       case when d % 13 = 0 then concat('ALT-', cast(d as varchar(20))) else '' end as Aliases,
       concat('D', cast(dm as varchar(20))) as Doc_Name,
       case dm when 0 then 'FCSS' when 1 then 'FCSRD' when 2 then 'CCSRD' else 'SRS' end as Doc_Type,
       case dm when 0 then 'System_High' when 1 then 'System_Mid' when 2 then 'Software_High' else 'Software_Low' end as Level,
       case when q % 8 = 0 then sec when d % 41 = 6 then '' else concat(sec, '-', cast(q % 8 as varchar(20))) end as Object_Number,
       replace(text, chr(10), ' ') as Requirement_Text,
       case when d % 10 = 0 then null when d % 3 = 0 and d >= 8 then
            concat('REQ-', case when d - 4 < 10000 then lpad(cast(d - 4 as varchar(20)), 5, '0') else cast(d - 4 as varchar(20)) end,
                   ', REQ-', case when d - 8 < 10000 then lpad(cast(d - 8 as varchar(20)), 5, '0') else cast(d - 8 as varchar(20)) end)
            else '' end as Parent_Req_IDs,
       case when dm = 1 then
            concat('REQ-', case when d + 4 < 10000 then lpad(cast(d + 4 as varchar(20)), 5, '0') else cast(d + 4 as varchar(20)) end)
            else '' end as Child_Req_IDs,
       case when d % 9 = 0 then '' else concat('Context ', cast(d as varchar(20))) end as Combined_Text,
       case cast(floor(q / 8) as int) % 3 when 0 then concat('Section ', sec) when 1 then concat(sec, '  Scope') else '' end as Section_Title,
       case when d % 43 = 7 then '' when q % 8 = 0 then sec else concat(sec, '-', cast(q % 8 as varchar(20))) end as Section_Number,
       case when q % 8 = 0 then 'Heading' else '' end as Section_Type,
       q % 8 = 0 as Is_Section_Header, d % 2 = 0 as Section_Inferred, 'v1' as Schema_Version,
       case when q % 8 = 0 then 'Header' when d % 5 = 0 then 'Requirement' when d % 5 = 1 then '' end as Requirement_Type,
       case when d % 4 = 0 then lang end as Safety, case when d % 6 = 0 then source end as Rationale,
       case when d % 8 = 1 then 'yes' when d % 8 = 2 then 'no' end as Is_Derived
from req_base
"""

FIXTURES["srs_rows"] = """
select doc_id as d, concat(cast(doc_id % 5 + 1 as varchar(20)), '.', cast(doc_id % 4 + 1 as varchar(20))) as sec,
       cast(doc_id % 20 as varchar(20)) as num,
       concat('The system shall meet ', cast(doc_id % 40 as varchar(20))) as body,
       concat('DOC-', cast(doc_id as varchar(20)), case when doc_id % 2 = 0 then ';doc-7' else '' end) as trace,
       case when doc_id % 3 = 0 then source end as trace_source
from documents
"""

# Three large groups whose distinct values grow with the data.
FIXTURES["uses"] = """
select l_orderkey, l_linenumber, l_returnflag as flag, concat('part-', cast(l_partkey as varchar(20))) as used,
       case when l_partkey % 3 = 0 then concat('order-', cast(l_orderkey as varchar(20)), ',order-7') end as cited
from lineitem
"""

FIXTURES["ssg_rows"] = """
select doc_id as d, case when doc_id % 29 = 3 then '' else concat('ssg-', cast(doc_id as varchar(20))) end as req,
       case doc_id % 7 when 0 then 'Info' when 1 then 'Title' when 2 then 'Note' end as kind,
       replace(text, chr(10), ' ') as body
from documents
"""

FIXTURES["md_docs"] = """
select doc_id, concat('/docs/', cast(doc_id as varchar(20)), '.md') as path,
       concat('---', chr(10), 'doc_name: "Doc ', cast(doc_id as varchar(20)), '"', chr(10), 'tags: alpha', chr(10),
              'Section_Number: ', cast(doc_id % 9 + 1 as varchar(20)), '.', cast(doc_id % 4 as varchar(20)), '-1', chr(10),
              '---', chr(10), '# Title ', cast(doc_id as varchar(20)), chr(10),
              'Req_ID: REQ-', cast(doc_id as varchar(20)), chr(10), 'Object_Number: 2.', cast(doc_id % 9 as varchar(20)), chr(10),
              text, chr(10), '---', chr(10), '## Part two', chr(10), text, chr(10), '### Deep', chr(10), 'x', chr(10),
              '---', chr(10), '---', chr(10), '# Last', chr(10), 'tail') as md
from documents
"""

# The same documents at two times: some moved to a new path, some changed.
FIXTURES["docs_current"] = """
select case when doc_id % 20 = 0 then concat('/moved/', cast(doc_id as varchar(20))) else concat('/docs/', cast(doc_id as varchar(20))) end as source_path,
       case when doc_id % 13 = 0 then concat(text, ' x') else text end as text
from documents
"""

FIXTURES["docs_manifest"] = """
select concat('/docs/', cast(doc_id as varchar(20))) as source_path, text as old_text from documents
"""

FIXTURES["doc_text"] = """
select doc_id, text, case when doc_id % 2 = 0 then '.pdf' else '.md' end as ext from documents
"""

FIXTURES["names_left"] = """
select distinct p_name as name from part
"""

FIXTURES["names_right"] = """
select distinct case when p_partkey % 2 = 0 then substr(p_name, 1, length(p_name) - 1) else p_name end as name from part
"""


# The same rows as the fixture of that name, for Spark: lines move once for their own groups and once to their supplier,
# and names join the groups after they are formed.
BUILT = {}

BUILT["flat_marked"] = """
select p.reg, p.nat, g.sup, g.ord, g.line, g.pk, g.qty, p.r_name, p.n_name, p.s_name,
       case when g.ord * 100 + g.line = f.first_line then 1 else 0 end as new_sup,
       case when g.line = g.first_word then 1 else 0 end as new_ws
from (select *, min(line) over (partition by sup, ord) as first_word
      from (select sup, ord, line, min(pk) as pk, min(qty) as qty
            from (select /*+ REPARTITION(sup, ord) */ * from
                  (select l_suppkey as sup, l_orderkey as ord, l_linenumber as line, l_partkey as pk, l_quantity as qty
                   from lineitem where l_suppkey is not null and l_orderkey is not null) as l) as moved
            group by sup, ord, line) as grouped) as g
     join (select n_regionkey as reg, s_nationkey as nat, s_suppkey as sup,
                  min(r_name) as r_name, min(n_name) as n_name, min(s_name) as s_name
           from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
           group by n_regionkey, s_nationkey, s_suppkey) as p on g.sup = p.sup
     join (select l_suppkey as sup, min(l_orderkey * 100 + l_linenumber) as first_line from lineitem group by l_suppkey) as f
       on p.sup = f.sup
"""


def with_fixtures(sql: str, fixtures: Mapping[str, str] = FIXTURES) -> str:
    """Put every fixture a query names in front of it, those it builds on first."""
    ordered: list[str] = []

    def visit(body: str) -> None:
        for name in fixtures:
            if name not in ordered and re.search(rf"\b{name}\b", body):
                visit(fixtures[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    head = ",\n".join(f"{n} as ({fixtures[n].strip()})" for n in ordered)
    body = sql.strip()
    for opening in ("with recursive ", "with "):
        if body.startswith(opening):
            return f"{opening}{head},\n{body[len(opening):]}"
    return f"with {head}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # The given texts are one file with one row group, which one task would read.
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if name == "documents" else df


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived fixture as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = with_fixtures(f"select * from {name}", {**FIXTURES, **BUILT})
    used: set[str] = set()

    def placeholder(m: re.Match) -> str:
        if m[2] not in TABLES:
            return m[0]
        used.add(m[2])
        return f"{m[1]} {{{m[2]}}}"

    sql = re.sub(r"\b(from|join) (\w+)", placeholder, sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})
