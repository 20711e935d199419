"""Requirement sheets to normalised rows, rejections, star tables and summaries."""

from pyspark.sql import functions as F

from tracegrid.checks import check
from tracegrid.checks.text import BL, sql_dedupe, sql_norm_id, sql_parse_ids, sql_split_ids, sql_strip
from tracegrid.fixtures import fixture
from tracegrid.operators import requirements as r
from tracegrid.operators.ordered import union_all

SHEET = {
    "req": "Requirement ID",
    "num": "Object Number",
    "body": "Requirement Text",
    "kind": "Requirement Type",
    "up": "Out-links (SRD)",
    "up2": "Out-links (Product)",
    "down": "In-links (All)",
    "safety": "Safety",
}

KIND = r.DocKind(
    "FCSRD",
    "fcsrd",
    required=("Requirement ID", "Object Number", "Requirement Text"),
    optional=("Requirement Type", "Safety", "Absent"),
    parents=("Out-links (SRD)", "Out-links (Product)"),
    children=("In-links (All)",),
    sections=r.SectionRule(("Requirement Text",)),
)


def sheet(spark, sf):
    return fixture(spark, sf, "req_rows").withColumnsRenamed(SHEET)


def normalized(spark, sf, dedupe=True):
    doc = r.Document(F.col("doc_name"), "FCSRD", "Software_High")
    return r.normalize_traceable(
        sheet(spark, sf), KIND, doc, ["d"], ["doc_name"], list(SHEET.values()), dedupe_links=dedupe
    )


NL = "chr(10)"

CONTEXT = f"""
cells as (
  select doc_name, d, {sql_strip('req')} as id_cell, {sql_strip('num')} as num, {sql_strip('body')} as body,
         {sql_strip('kind')} as kind, up, up2, down, {sql_strip('safety')} as safety from req_rows),
heads as (
  select *, (num <> '' and not contains(num, '-') and body <> '')
            or (num = '' and body <> '' and (contains(lower(kind), 'header') or contains(lower(kind), 'heading') or contains(lower(kind), 'section title'))) as hdr
  from cells),
ctx as (
  select *,
    coalesce(last_value(case when hdr then body end ignore nulls) over w, '') as ctx_title,
    coalesce(last_value(case when hdr then num end ignore nulls) over w, '') as ctx_number,
    coalesce(last_value(case when hdr then case when kind <> '' then kind when num <> '' then 'section' else 'header' end end ignore nulls) over w, '') as ctx_type,
    sum(case when hdr then 1 else 0 end) over w as ctx_headers,
    row_number() over (partition by doc_name order by d) - 1 as Row_Index,
    list_transform({sql_split_ids('id_cell')}, lambda x: {sql_norm_id('x')}) as ids
  from heads window w as (partition by doc_name order by d rows between unbounded preceding and current row))
"""


@check(
    "section_context",
    f"""with {CONTEXT} select doc_name, d, ctx_title, ctx_number, ctx_type, hdr as ctx_is_header,
       cast(ctx_headers as bigint) as ctx_headers, Row_Index from ctx""",
)
def _(spark, sf):
    done = r.section_context(sheet(spark, sf), KIND.sections, ["d"], ["doc_name"], list(SHEET.values()))
    return done.select(
        "doc_name", "d", "ctx_title", "ctx_number", "ctx_type", "ctx_is_header", "ctx_headers", "Row_Index"
    )


REJECTED = f"""
select doc_name as Doc_Name, 'FCSRD' as Doc_Type, 'Software_High' as Level,
       case when len(ids) = 0 then 'missing_requirement_id' else 'missing_object_number' end as Reason,
       id_cell as Raw_Requirement_ID, num as Object_Number, '' as Section_Number, Row_Index
from ctx where not hdr and (len(ids) = 0 or num = '')"""

check("split_rejections", f"with {CONTEXT} {REJECTED}")(lambda spark, sf: normalized(spark, sf)[1])

LEAD = f"'^([0-9]+(?:[.-][0-9]+)*[A-Za-z]?)[.{BL}-]+([^\n]*)\\z'"


def sql_infer(source: str) -> str:
    """The inference chain over records with their context, as ``final``."""
    return f"""
lead as (select *, regexp_extract(Requirement_Text, {LEAD}, 1) as lead_num, {sql_strip(f"regexp_extract(Requirement_Text, {LEAD}, 2)")} as lead_rest,
         list_filter(string_split(Req_ID, '-'), lambda x: x <> '') as toks from {source}),
parts as (select *, case when len(toks) > 1 and regexp_matches(toks[1], '^\\p{{L}}+$') then toks[2:] else toks end as rest,
         case when lead_num <> '' then lead_rest when length(Requirement_Text) < 150 then Requirement_Text else '' end as text_title from lead),
offers as (select *, array_to_string(rest[1:len(rest) - 1], '-') as id_section, coalesce(rest[len(rest)], '') as id_number from parts),
final as (select * replace (
    coalesce(nullif(Section_Title, ''), nullif(ctx_title, ''), nullif(text_title, ''), '') as Section_Title,
    coalesce(nullif(Section_Number, ''), nullif(ctx_number, ''), nullif(Object_Number, ''), nullif(lead_num, ''), nullif(id_section, ''), '') as Section_Number,
    coalesce(nullif(Section_Type, ''), nullif(ctx_type, ''), '') as Section_Type,
    coalesce(nullif(Object_Number, ''), nullif(ctx_number, ''), nullif(id_number, ''), '') as Object_Number),
  coalesce(nullif(ctx_title, ''), nullif(ctx_number, '')) as Section, nullif(ctx_title, '') as SectionTitle,
  (Section_Title = '' and coalesce(nullif(ctx_title, ''), text_title) <> '')
  or (Section_Number = '' and (ctx_number <> '' or Object_Number <> '' or lead_num <> '' or id_section <> ''))
  or (Section_Type = '' and ctx_type <> '') or (Object_Number = '' and (ctx_number <> '' or id_number <> ''))
  or ctx_title <> '' or ctx_number <> '' as Section_Inferred
  from offers)"""


def sql_normalized(dedupe: bool) -> str:
    both = f"list_concat({sql_parse_ids('up')}, {sql_parse_ids('up2')})"
    parents = sql_dedupe(both) if dedupe else both
    return f"""{CONTEXT},
linked as (select *, array_to_string({parents}, ', ') as pars, array_to_string({sql_parse_ids('down')}, ', ') as kids,
           coalesce(ids[1], '') as pid, array_to_string(ids[2:], ', ') as als from ctx where hdr or (len(ids) > 0 and num <> '')),
rec as (
  select case when hdr then case when id_cell <> '' then id_cell when num <> '' then num else 'SECTION_' || ctx_headers end else pid end as Req_ID,
         case when hdr then '' else als end as Aliases, doc_name as Doc_Name, 'FCSRD' as Doc_Type, 'Software_High' as Level,
         num as Object_Number, body as Requirement_Text, case when hdr then '' else pars end as Parent_Req_IDs,
         case when hdr then '' else kids end as Child_Req_IDs,
         case when hdr then 'Section: ' || case when num = '' then 'N/A' else num end || '\\nTitle: ' || ctx_title || '\\nDocument: ' || doc_name || ' (FCSRD)\\nLevel: Software_High'
              else concat_ws({NL}, 'Requirement ID: ' || pid, 'Document: ' || doc_name || ' (FCSRD)', 'Level: Software_High',
                'Section Title: ' || nullif(ctx_title, ''), 'Section Number: ' || nullif(ctx_number, ''), 'Aliases: ' || nullif(als, ''),
                'Requirement Type: ' || nullif(kind, ''), 'Safety: ' || nullif(safety, ''),
                'Parent Requirements: ' || coalesce(nullif(pars, ''), '<none>'), 'Child Requirements: ' || coalesce(nullif(kids, ''), '<none>'),
                {NL} || 'Requirement Text:' || {NL} || nullif(body, '')) end as Combined_Text,
         ctx_title as Section_Title, ctx_number as Section_Number,
         case when hdr then ctx_type when lower(kind) = 'header' then ctx_type else coalesce(nullif(kind, ''), ctx_type) end as Section_Type,
         hdr as Is_Section_Header, case when not hdr then kind end as Requirement_Type, case when not hdr then safety end as Safety,
         Row_Index, ctx_title, ctx_number, ctx_type from linked),
{sql_infer('rec')}"""


NORMAL_COLUMNS = (
    "Req_ID, Aliases, Doc_Name, Doc_Type, Level, Object_Number, Requirement_Text, Parent_Req_IDs, Child_Req_IDs, Combined_Text, "
    "Section_Title, Section_Number, Section_Type, Is_Section_Header, Requirement_Type, Safety, Row_Index, Section, SectionTitle, Section_Inferred"
)

check("normalize_fcss", f"with {sql_normalized(False)} select {NORMAL_COLUMNS} from final")(
    lambda spark, sf: normalized(spark, sf, dedupe=False)[0]
)
check("normalize_generic", f"with {sql_normalized(True)} select {NORMAL_COLUMNS} from final")(
    lambda spark, sf: normalized(spark, sf)[0]
)


@check(
    "infer_sections",
    f"""with rec as (select Req_ID, Requirement_Text, Section_Title, Section_Number, '' as Section_Type,
         Object_Number, '' as ctx_title, '' as ctx_number, '' as ctx_type, row_idx from reqs),
{sql_infer("(select * replace (" + sql_strip('Requirement_Text') + " as Requirement_Text) from rec)")}
select Req_ID, row_idx, Section_Title, Section_Number, Object_Number, Section_Inferred from final""",
)
def _(spark, sf):
    df = fixture(spark, sf, "reqs").select(
        "Req_ID", "row_idx", "Requirement_Text", "Section_Title", "Section_Number", "Object_Number"
    )
    return r.infer_sections(df, r.InferRule(from_context=False)).drop("Requirement_Text")


@check(
    "validate_columns",
    """select 'D1' as Doc_Name, unnest(['Object Number', 'Requirement Text']) as missing_column, count(*) as rows from req_rows""",
)
def _(spark, sf):
    full = sheet(spark, sf)
    return r.validate_columns([("D0", full, KIND), ("D1", full.drop("Object Number", "Requirement Text"), KIND)])


SRS_KIND = r.DocKind(
    "SRS",
    "srs",
    ids=("SRS Section", "Req't No"),
    texts=("Requirement Text",),
    optional=("Traceability Doc Reqd #", "Trace Source"),
    parents=("Traceability Doc Reqd #",),
    infer=r.InferRule(
        from_context=False,
        from_object_number=False,
        object_number="SRS_Local_Req_No",
        section_number="SRS_Section",
        section_type=None,
    ),
)


def srs_sheet(spark, sf):
    return fixture(spark, sf, "srs_rows").withColumnsRenamed(
        {
            "sec": "SRS Section",
            "num": "Req't No",
            "body": "Requirement Text",
            "trace": "Traceability Doc Reqd #",
            "trace_source": "Trace Source",
        }
    )


def sql_merged(value: str, extra: str = "") -> str:
    """Distinct values of a group in order of first appearance, joined."""
    return f"(select string_agg(v, '{value}' order by o, p) from m where m.sec = g.sec and m.num = g.num and m.body = g.body and m.what = '{extra}')"


SRS_SQL = f"""
g as (select sec, num, body, min(d) as first_d, count(*) as n, row_number() over (order by min(d)) as k from srs_rows group by 1, 2, 3),
every as (
  select sec, num, body, 'ids' as what, d as o, unnest({sql_parse_ids('trace')}) as v, generate_subscripts({sql_parse_ids('trace')}, 1) as p from srs_rows
  union all select sec, num, body, 'trace', d, {sql_strip('trace')}, 0 from srs_rows
  union all select sec, num, body, 'source', d, {sql_strip('trace_source')}, 0 from srs_rows),
m as (select sec, num, body, what, v, (min((o, p)))[1] as o, (min((o, p)))[2] as p from every where v <> '' group by sec, num, body, what, v),
rec as (
  select g.*, 'SRS-' || sec || '-' || num as Req_ID, coalesce({sql_merged(', ', 'ids')}, '') as pars,
         coalesce({sql_merged(' | ', 'trace')}, '') as traces, coalesce({sql_merged(' | ', 'source')}, '') as sources from g)
"""


@check(
    "merge_duplicates",
    f"""with {SRS_SQL} select sec as section, num as number, body, first_d as d, n as group_rows, pars as parents, traces, sources from rec""",
)
def _(spark, sf):
    df = r.merge_duplicates(
        fixture(spark, sf, "srs_rows"), ["sec", "num", "body"], ["d"], ["trace"], ["trace", "trace_source"]
    )
    return df.select(
        F.col("sec").alias("section"),
        F.col("num").alias("number"),
        "body",
        "d",
        "group_rows",
        F.array_join(F.col("ids")["trace"], ", ").alias("parents"),
        F.col("texts")["trace"].alias("traces"),
        F.col("texts")["trace_source"].alias("sources"),
    )


@check(
    "merge_duplicates_parts",
    """with v as (
  select flag, 't' as kind, used as value, min((l_orderkey, l_linenumber, 0)) as spot from uses group by flag, used
  union all
  select flag, 'i', value, min((l_orderkey, l_linenumber, pos)) from (
    select flag, l_orderkey, l_linenumber, unnest([format('ORDER-{:05d}', l_orderkey), 'ORDER-00007']) as value, unnest([0, 1]) as pos
    from uses where cited is not null) group by flag, value),
p as (select *, cast(floor((row_number() over (partition by flag, kind order by spot, value) - 1) / 100) as int) + 1 as part from v),
m as (
  select flag, part, string_agg(value, ' | ' order by spot, value) filter (where kind = 't') as used,
         string_agg(value, ', ' order by spot, value) filter (where kind = 'i') as cited from p group by flag, part),
g as (select flag, count(*) as group_rows, min((l_orderkey, l_linenumber)) as f from uses group by flag)
select flag, f[1] as l_orderkey, f[2] as l_linenumber, group_rows, part, max(part) over (partition by flag) as parts,
       coalesce(used, '') as used, coalesce(cited, '') as cited from g join m using (flag)""",
)
def _(spark, sf):
    """Three groups that hold all rows, in parts of a hundred values."""
    merged = r.merge_duplicates(
        fixture(spark, sf, "uses"), ["flag"], ["l_orderkey", "l_linenumber"], ["cited"], ["used"], part_size=100
    )
    return merged.select(
        "flag", "l_orderkey", "l_linenumber", "group_rows", "part", "parts",
        F.col("texts")["used"].alias("used"), F.array_join(F.col("ids")["cited"], ", ").alias("cited"),
    )


@check(
    "normalize_srs",
    f"""with {SRS_SQL}
select Req_ID, '' as Aliases, 'SRS' as Doc_Name, 'SRS' as Doc_Type, 'Software_Low' as Level, sec as SRS_Section, num as SRS_Local_Req_No,
       body as Requirement_Text, pars as Parent_Req_IDs, '' as Child_Req_IDs,
       concat_ws({NL}, 'Requirement ID: ' || Req_ID, 'Document: SRS (SRS)', 'Level: Software_Low', 'SRS Section: ' || sec, 'SRS Local Req Number: ' || num,
         'Traceability Doc Reqd #: ' || nullif(traces, ''), 'Trace Source: ' || nullif(sources, ''),
         'Parent Requirements: ' || coalesce(nullif(pars, ''), '<none>'), 'Child Requirements: <none>', {NL} || 'Requirement Text:' || {NL} || body) as Combined_Text,
       body as Section_Title, sec as Section_Number, '' as Section_Type, false as Is_Section_Header, first_d as Row_Index, true as Section_Inferred
from rec""",
)
def _(spark, sf):
    doc = r.Document("SRS", "SRS", "Software_Low")
    return r.normalize_merged(srs_sheet(spark, sf), SRS_KIND, doc, ["d"])[0]


SSG_KIND = r.DocKind("SSG", "ssg", ids=("ID",), texts=("Guideline",), optional=("Object Type",), infer=r.NO_INFERENCE)


def ssg(spark, sf):
    df = fixture(spark, sf, "ssg_rows").withColumnsRenamed({"req": "ID", "kind": "Object Type", "body": "Guideline"})
    return r.normalize_guideline(df, SSG_KIND, r.Document("SSG", "SSG", "Guideline"), ["d"], skip_object_types=["NOTE"])


SSG_SQL = f"""
c as (select d, row_number() over (order by d) - 1 as Row_Index, {sql_strip('req')} as id_cell, {sql_strip('kind')} as kind, {sql_strip('body')} as body,
             {sql_norm_id(sql_strip('req'))} as rid from ssg_rows)
"""


@check(
    "normalize_ssg",
    f"""with {SSG_SQL}
select rid as Req_ID, '' as Aliases, 'SSG' as Doc_Name, 'SSG' as Doc_Type, 'Guideline' as Level, body as Requirement_Text,
       concat_ws({NL}, 'Requirement ID: ' || rid, 'Document: SSG (SSG)', 'Level: Guideline', 'Object Type: ' || nullif(kind, ''),
         {NL} || 'Requirement Text:' || {NL} || nullif(body, '')) as Combined_Text,
       '' as Parent_Req_IDs, '' as Child_Req_IDs, Row_Index, false as Section_Inferred
from c where rid <> '' and lower(kind) not in ('info', 'title', 'note')""",
)
def _(spark, sf):
    return ssg(spark, sf)[0]


@check(
    "split_rejections_ssg",
    f"""with {SSG_SQL}
select 'SSG' as Doc_Name, 'SSG' as Doc_Type, 'Guideline' as Level,
       case when rid = '' then 'missing_requirement_id' else 'filtered_object_type:' || kind end as Reason,
       id_cell as Raw_Requirement_ID, '' as Object_Number, '' as Section_Number, Row_Index
from c where rid = '' or lower(kind) in ('info', 'title', 'note')""",
)
def _(spark, sf):
    return ssg(spark, sf)[1]


@check(
    "flag_header_types",
    """select row_idx, case when lower(trim(coalesce(Requirement_Type, ''))) <> 'requirement'
         and ((Object_Number <> '' and not contains(Object_Number, '-')) or (Object_Number = '' and Section_Number <> '' and not contains(Section_Number, '-')))
       then 'Header' else coalesce(Requirement_Type, '') end as Requirement_Type from reqs""",
)
def _(spark, sf):
    return r.flag_header_types(fixture(spark, sf, "reqs")).select("row_idx", "Requirement_Type")


@check(
    "star_documents",
    """select row_number() over (order by min(row_idx)) as id, Doc_Name as doc_name, min_by(Doc_Type, row_idx) as doc_type, min_by(Level, row_idx) as level
from reqs group by Doc_Name""",
)
def _(spark, sf):
    return r.build_star(fixture(spark, sf, "reqs"), ["row_idx"])["documents"]


@check(
    "star_requirements",
    """with docs as (select row_number() over (order by min(row_idx)) as doc_id, Doc_Name as dn from reqs group by Doc_Name),
u as (select * from (select *, row_number() over (partition by Req_ID, Doc_Name order by row_idx) as rn from reqs) where rn = 1)
select row_number() over (order by row_idx) as id, Req_ID as req_id, doc_id, Requirement_Text as requirement_text, Combined_Text as combined_text,
       Section_Number as section_number, Section_Title as section_title, Aliases as aliases from u join docs on Doc_Name = dn""",
)
def _(spark, sf):
    return r.build_star(fixture(spark, sf, "reqs"), ["row_idx"])["requirements"]


TRACES = f"""
edges as (
  select row_idx, 0 as side, generate_subscripts({sql_split_ids('Parent_Req_IDs')}, 1) as pos, Req_ID as source_req_id, unnest({sql_split_ids('Parent_Req_IDs')}) as target_req_id from reqs
  union all
  select row_idx, 1, generate_subscripts({sql_split_ids('Child_Req_IDs')}, 1), unnest({sql_split_ids('Child_Req_IDs')}), Req_ID from reqs)
"""


@check(
    "star_traces",
    f"""with {TRACES}
select row_number() over (order by min((row_idx, side, pos))) as id, source_req_id, target_req_id, 'parent' as trace_type
from edges group by source_req_id, target_req_id""",
)
def _(spark, sf):
    return r.build_star(fixture(spark, sf, "reqs"), ["row_idx"])["traces"]


@check(
    "union_documents",
    """select row_idx, Doc_Name, Safety, cast(null as varchar) as source from reqs
union all select doc_id, 'extra', null, source from documents""",
)
def _(spark, sf):
    extra = fixture(spark, sf, "documents").select(
        F.col("doc_id").alias("row_idx"), F.lit("extra").alias("Doc_Name"), "source"
    )
    return union_all([fixture(spark, sf, "reqs").select("row_idx", "Doc_Name", "Safety"), extra])


@check(
    "normalization_summary",
    f"""with {CONTEXT}
select doc_name as Doc_Name, 'FCSRD' as Doc_Type, count(*) as total_rows, count(*) filter (where hdr or (len(ids) > 0 and num <> '')) as produced_rows,
       count(*) filter (where hdr) as section_headers, count(*) filter (where not hdr and len(ids) = 0) as missing_requirement_id,
       count(*) filter (where not hdr and len(ids) > 0 and num = '') as missing_object_number, 0 as filtered_object_type, 0 as duplicate_rows_collapsed
from ctx group by doc_name""",
)
def _(spark, sf):
    accepted, rejected = normalized(spark, sf)
    totals = sheet(spark, sf).groupBy(F.col("doc_name").alias("Doc_Name"), F.lit("FCSRD").alias("Doc_Type")).agg(
        F.count("*").alias("total_rows")
    )
    return r.normalization_summary(totals, accepted, rejected)
