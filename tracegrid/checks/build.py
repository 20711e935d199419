"""Several sheets through the whole requirements build."""

from pyspark.sql import functions as F

from tracegrid.checks import check
from tracegrid.checks.requirements import (
    KIND,
    SHEET,
    SRS_KIND,
    SRS_SQL,
    SSG_KIND,
    SSG_SQL,
    sheet,
    sql_normalized,
    srs_sheet,
)
from tracegrid.fixtures import fixture
from tracegrid.plans.requirements import Sheet, build_requirements


def built(spark, sf):
    rows = sheet(spark, sf)
    sheets = [
        Sheet(rows.where(F.col("doc_name") == name).select("d", *SHEET.values()), KIND, name, "Software_High", ["d"])
        for name in ("D0", "D1", "D2", "D3")
    ]
    guideline = fixture(spark, sf, "ssg_rows").withColumnsRenamed({"req": "ID", "kind": "Object Type", "body": "Guideline"})
    sheets += [
        Sheet(rows.drop("Object Number"), KIND, "Incomplete", "Software_High", ["d"]),
        Sheet(srs_sheet(spark, sf), SRS_KIND, "SRS", "Software_Low", ["d"]),
        Sheet(guideline, SSG_KIND, "SSG", "Guideline", ["d"], ["note"]),
    ]
    return build_requirements(sheets, "v1")


HEADER = """case when lower(trim(coalesce(t, ''))) <> 'requirement' and ((num <> '' and not contains(num, '-'))
  or (num = '' and sec <> '' and not contains(sec, '-'))) then 'Header' else coalesce(t, '') end"""

BUILT = f"""{sql_normalized(True)},
{SRS_SQL.replace('rec as', 'srs_rec as')},
{SSG_SQL},
stacked as (
  select cast(substr(Doc_Name, 2) as int) as seq, Row_Index as ri, Req_ID, Doc_Name, Requirement_Type as t, Object_Number as num, Section_Number as sec from final
  union all select 5, first_d, Req_ID, 'SRS', null, '', sec from srs_rec
  union all select 6, Row_Index, rid, 'SSG', null, '', '' from c where rid <> '' and lower(kind) not in ('info', 'title', 'note')),
numbered as (select *, row_number() over (order by seq, ri) - 1 as row_idx, {HEADER} as kind from stacked)"""


@check("build_requirements", f"with {BUILT} select row_idx, Req_ID, Doc_Name, kind as Requirement_Type, 'v1' as Schema_Version from numbered")
def _(spark, sf):
    return built(spark, sf).rows.select("row_idx", "Req_ID", "Doc_Name", "Requirement_Type", "Schema_Version")


@check(
    "build_summary",
    f"""with {BUILT},
t as (select doc_name as dn, count(*) as total_rows from req_rows group by 1 union all select 'SRS', count(*) from srs_rows union all select 'SSG', count(*) from ssg_rows),
p as (select Doc_Name as dn, count(*) as produced_rows from numbered group by 1)
select dn as Doc_Name, total_rows, produced_rows, case when dn = 'SRS' then total_rows - produced_rows else 0 end as duplicate_rows_collapsed from t join p using (dn)""",
)
def _(spark, sf):
    return built(spark, sf).summary.select("Doc_Name", "total_rows", "produced_rows", "duplicate_rows_collapsed")
