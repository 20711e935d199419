"""Requirements rendered to text."""

from pyspark.sql import functions as F

from tracegrid.checks import check
from tracegrid.checks.text import BC, BL, sql_strip
from tracegrid.checks.trace import LINKED, TITLES
from tracegrid.checks.views import MEMBERS, NUM, _part, reqs
from tracegrid.fixtures import fixture
from tracegrid.operators import packaging, render

NL = "chr(10)"
ORDER = ["row_idx"]


def J(*parts: str) -> str:
    return f"concat_ws({NL}, {', '.join(parts)})"


def Q(name: str, value: str) -> str:
    return f"""'{name}: "' || {value} || '"'"""


def opt(prefix: str, value: str) -> str:
    return f"'{prefix}' || nullif({value}, '')"


def one_line(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BC}+', ' ', 'g'), '{BL}')"


@check(
    "section_title_maps",
    """with t as (select *, split_part(Section_Number, '-', 1) as base from reqs where Section_Number <> '' and Section_Title <> '')
select 'number' as kind, Section_Number as section, min_by(Section_Title, row_idx) as title from t group by 2
union all select 'prefix', base, min_by(Section_Title, row_idx) from t group by 2
union all select 'prefix', split_part(base, '.', 1), min_by(Section_Title, row_idx) from t group by 2""",
)
def _(spark, sf):
    return render.section_title_maps(reqs(spark, sf), ORDER)


@check(
    "section_folders",
    """with t as (select *, split_part(Section_Number, '-', 1) as base from reqs where Section_Number <> ''),
p as (select base as prefix, min_by(Section_Title, row_idx) as title from t where Section_Title <> '' group by 1
      union all select split_part(base, '.', 1), min_by(Section_Title, row_idx) from t where Section_Title <> '' group by 1),
n as (select prefix, left(replace(prefix, '.', '_') || '_' || trim(regexp_replace(title, '[^A-Za-z0-9_.-]+', '_', 'g'), '._-'), 80) as name from p),
s as (select distinct Section_Number, base, split_part(base, '.', 1) as top from t)
select Section_Number as folder_section, coalesce(a.name, top) || '/' || coalesce(b.name, replace(base, '.', '_')) as section_folder
from s left join n a on a.prefix = top left join n b on b.prefix = base""",
)
def _(spark, sf):
    return render.section_folders(reqs(spark, sf), ORDER)


SLUG = "trim(regexp_replace({}, '[^A-Za-z0-9_.-]+', '_', 'g'), '._-')"

BASE = f"""
{TITLES},
b as (
  select r.* replace (coalesce(Parent_Req_IDs, '') as Parent_Req_IDs, coalesce(Requirement_Type, '') as Requirement_Type, {sql_strip('Requirement_Text')} as Requirement_Text,
                      coalesce(Safety, '') as Safety, coalesce(Rationale, '') as Rationale),
         coalesce(title, Section_Title) as rtitle, coalesce(nullif(Object_Number, ''), Section_Number) as sect, split_part(Section_Number, '-', 1) as base,
         row_number() over (partition by Doc_Name, Req_ID order by row_idx) - 1 as nth
  from reqs r left join titles on Section_Number = num)
"""
NAME = "Req_ID || case when nth > 0 then '-' || nth else '' end"

FIELDS = [
    Q("Req_ID", "Req_ID"), Q("Doc_Name", "Doc_Name"), Q("Doc_Type", "Doc_Type"), Q("Requirement_Type", "Requirement_Type"),
    Q("Level", "Level"), Q("Parents", "Parent_Req_IDs"), Q("Children", "Child_Req_IDs"), Q("Aliases", "Aliases"),
    Q("SRS_Local_Req_No", "''"), Q("Section", "sect"), Q("Section_Title", "rtitle"), Q("Section_Type", "Section_Type"),
]


def summary(*pairs: tuple[str, str]) -> str:
    return f"concat_ws('  ' || {NL}, {', '.join(opt(f'**{n}:** ', c) for n, c in pairs)}"


CONTEXT = f"'---' || {NL} || {NL} || '## Combined Context' || {NL} || {NL} || nullif(Combined_Text, '') || {NL}"
TEXT = f"'## Requirement Text' || {NL} || {NL} || nullif(Requirement_Text, '') || {NL}"

MARKDOWN = J(
    "'---'",
    *FIELDS,
    Q("Schema_Version", "Schema_Version"),
    "'Section_Inferred: ' || cast(Section_Inferred as varchar)",
    "'---'",
    "''",
    "'# [' || Doc_Name || '] ' || Req_ID",
    "''",
    summary(
        ("Level", "Level"), ("Doc Type", "Doc_Type"), ("Parents", "Parent_Req_IDs"), ("Children", "Child_Req_IDs"), ("Aliases", "Aliases"),
        ("Requirement Type", "Requirement_Type"), ("Section", "sect"), ("Section Title", "rtitle"), ("Section Type", "Section_Type"),
        ("Schema Version", "Schema_Version"),
    )
    + f", case when Section_Inferred then '**Section Context:** inferred' end) || {NL}",
    TEXT,
    CONTEXT,
)


@check(
    "requirement_markdown",
    f"with {BASE} select row_idx, Doc_Name as doc_slug, Doc_Name as folder, {NAME} || '.md' as file_name, {MARKDOWN} as content from b",
)
def _(spark, sf):
    return render.requirement_markdown(reqs(spark, sf), ORDER)


@check(
    "rag_text",
    f"""with {BASE} select row_idx, Doc_Name as doc_slug, Doc_Name as folder, {NAME} || '.txt' as file_name,
{J("'Tag: Info'", *[opt(f'{n}: ', c) for n, c in (
    ('Requirement ID', 'Req_ID'), ('Doc Name', 'Doc_Name'), ('Doc Type', 'Doc_Type'), ('Level', 'Level'), ('Schema Version', 'Schema_Version'),
    ('Section', 'Section_Number'), ('Section Title', 'rtitle'), ('Section Type', 'Section_Type'), ('Requirement Type', 'Requirement_Type'),
    ('Parents', 'Parent_Req_IDs'), ('Children', 'Child_Req_IDs'), ('Aliases', 'Aliases'), ('Requirement Text', 'Requirement_Text'))],
   f"{NL} || 'Combined Text:' || {NL} || nullif(Combined_Text, '')")} || {NL} as content from b""",
)
def _(spark, sf):
    return render.rag_text(reqs(spark, sf), ORDER)


def snippets(c: str) -> str:
    """Bullets of linked ids with the text of the first row of each."""
    items = f"list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')"
    return (
        f"coalesce((select string_agg('- ' || x.rid || coalesce(': ' || nullif(i.line, ''), ''), {NL} order by x.pos) from "
        f"(select unnest({items}) as rid, generate_subscripts({items}, 1) as pos) x left join idx i on i.id = x.rid), '- None')"
    )


NEIGHBOURS = J(
    "'---'",
    *FIELDS,
    Q("Section_Anchor_ID", f"case when base <> '' then {SLUG.format('Doc_Name || chr(95) || chr(95) || Doc_Type || chr(95) || chr(95) || base')} else '' end"),
    Q("Sort_Key", "Doc_Type || '|' || base || '|' || coalesce(nullif(Object_Number, ''), Req_ID)"),
    Q("Neighbors_Prev", "coalesce(concat_ws(', ', p1, p2), '')"),
    Q("Neighbors_Next", "coalesce(concat_ws(', ', n1, n2), '')"),
    Q("Schema_Version", "Schema_Version"),
    "'---'",
    "'# ' || Req_ID",
    "''",
    summary(
        ("Doc Name", "Doc_Name"), ("Doc Type", "Doc_Type"), ("Level", "Level"), ("Section", "sect"), ("Section Title", "rtitle"),
        ("Section Anchor ID", f"case when base <> '' then {SLUG.format('Doc_Name || chr(95) || chr(95) || Doc_Type || chr(95) || chr(95) || base')} else '' end"),
        ("Section Type", "Section_Type"), ("Requirement Type", "Requirement_Type"), ("Parents", "Parent_Req_IDs"), ("Children", "Child_Req_IDs"),
        ("Aliases", "Aliases"), ("Schema Version", "Schema_Version"),
    )
    + f") || {NL}",
    TEXT,
    f"'## Local Neighbors (same section)' || {NL}",
    f"case when p1 is null and n1 is null then '_No neighboring requirements found in this section._' || {NL} end",
    f"'**Previous:**' || {NL} || '- ' || p1 || ': ' || t1 || coalesce({NL} || '- ' || p2 || ': ' || t2, '') || {NL}",
    f"'**Next:**' || {NL} || '- ' || n1 || ': ' || u1 || coalesce({NL} || '- ' || n2 || ': ' || u2, '') || {NL}",
    f"'## Trace Snippets' || {NL} || {NL} || '**Parents:**'",
    "par_lines",
    f"{NL} || '**Children:**'",
    "kid_lines",
    "''",
    CONTEXT,
)

MORE = MEMBERS.replace(
    "lead(line, 2) over o as nl", "lead(line, 2) over o as nl, lag(line) over o as t1, lag(line, 2) over o as t2, lead(line) over o as u1, lead(line, 2) over o as u2"
)


@check(
    "neighbour_markdown",
    f"""with {BASE}, {MORE},
idx as (select Req_ID as id, min_by({one_line('Requirement_Text')}, row_idx) as line from reqs group by 1),
pl as (select row_idx, {snippets('Parent_Req_IDs')} as par_lines, {snippets('Child_Req_IDs')} as kid_lines from b)
select b.row_idx, b.Doc_Name as doc_slug, b.Doc_Name as folder, {NAME} || '.md' as file_name, {NEIGHBOURS} as content
from b join pl using (row_idx) left join (select row_idx as widx, * exclude (row_idx) from w) on widx = b.row_idx""",
)
def _(spark, sf):
    return render.neighbour_markdown(reqs(spark, sf), ORDER, include_trace_text=True)


SORTED = f"case when Object_Number = '' then 1 else 0 end, {_part('Object_Number', 1)}, {_part('Object_Number', 2)}, coalesce(try_cast(split_part(Object_Number, '-', 2) as int), -1), lower(Req_ID), row_idx"

SECTION_HEAD = J(
    "'---'",
    Q("Doc_Name", "Doc_Name"),
    Q("Doc_Type", "Doc_Type"),
    Q("Level", "level"),
    Q("Section_Number", "base"),
    Q("Section_Title", "ttl"),
    Q("Section_Anchor_ID", "anchor_id"),
    Q("Requirement_Count", "n"),
    Q("Schema_Version", "'v1'"),
    """'Source: "section_export_v1"'""",
    "'---'",
    "rtrim('# ' || Doc_Name || ' Section ' || base || '  ' || ttl)",
    "''",
    "'## Section Details'",
    "''",
    "'- Doc Type: ' || Doc_Type",
    "'- Level: ' || level",
    "'- Section Number: ' || base",
    opt("- Section Title: ", "ttl"),
    "'- Section Anchor ID: ' || anchor_id",
    "'- Requirement Count: ' || n",
    "'- Schema Version: v1'",
    "'- Source: section_export_v1'",
    "''",
    f"'## Section Intro' || {NL} || {NL} || intro || {NL}",
    f"'## Section Headers' || {NL} || {NL} || heads || {NL}",
    "'## Requirements in this Section'",
    "''",
    "coalesce(members, '_No requirements captured for this section._')",
    "''",
)


@check(
    "section_documents",
    f"""with {BASE},
g as (select *, {one_line('Requirement_Text')} as line, {one_line('Combined_Text')} as ctx from b where base <> ''),
k as (select Doc_Name, Doc_Type, base, min(row_idx) as first_row, count(*) filter (where not Is_Section_Header) as n,
        case when count(distinct Level) > 1 then 'Mixed' else min(Level) end as level, coalesce(min_by(rtitle, row_idx) filter (where rtitle <> ''), '') as ttl,
        string_agg(case when Is_Section_Header then '- ' || coalesce(nullif(Object_Number, ''), base) || ': ' || coalesce(nullif(line, ''), rtitle)
                   || case when Combined_Text <> '' and Combined_Text <> Requirement_Text then {NL} || '  - Context: ' || ctx else '' end end, {NL} order by {SORTED}) as heads,
        string_agg(case when not Is_Section_Header then '- ' || Req_ID || ': ' || line end, {NL} order by {SORTED}) as members
      from g group by 1, 2, 3),
i as (select Doc_Name as dn, Doc_Type as dt, base as bs, string_agg('- ' || ctx, {NL} order by at_row) as intro
      from (select Doc_Name, Doc_Type, base, ctx, min(row_idx) as at_row from g where Combined_Text <> '' group by 1, 2, 3, 4) group by 1, 2, 3),
f as (select *, {SLUG.format("Doc_Name || chr(95) || chr(95) || Doc_Type || chr(95) || chr(95) || base")} as anchor_id,
        Doc_Name || '__' || base || '__' || case when ttl = '' then 'item' else {SLUG.format('ttl')} end as stem from k left join i on dn = Doc_Name and dt = Doc_Type and bs = base)
select Doc_Name as doc_slug, Doc_Name as folder, stem || '.md' as file_name, 1 as part, {SECTION_HEAD} as content from f""",
)
def _(spark, sf):
    return render.section_documents(reqs(spark, sf), ORDER)


def blocks(spark, sf):
    body = F.concat(F.lit("See REQ-3, alt-7 and "), "Req_ID", F.lit(". "), "Requirement_Text")
    short = F.when(F.col("row_idx") % 4 == 1, F.concat(F.lit("Short REQ-3 "), "Req_ID")).otherwise(body)
    df = reqs(spark, sf).withColumn("Requirement_Text", short)
    return render.rag_blocks(df, ORDER, ["Parent_Req_IDs"], ["Child_Req_IDs"])


BODY = "case when row_idx % 4 = 1 then 'Short REQ-3 ' || Req_ID else 'See REQ-3, alt-7 and ' || Req_ID || '. ' || Requirement_Text end"
BLOCK_LINKED = (
    LINKED.replace("'See REQ-3, alt-7 and ' || r.Req_ID || '. ' || Requirement_Text", BODY.replace("Req_ID", "r.Req_ID"))
    .replace("min_by('See REQ-3, alt-7 and ' || Req_ID || '. ' || Requirement_Text, row_idx)", f"min_by({BODY}, row_idx)")
)
NA = lambda c: f"coalesce(nullif(trim({c}, '{BL}'), ''), 'N/A')"

BLOCK = J(
    f"'## ' || Req_ID || case when {NA('rtitle')} <> 'N/A' then ': ' || rtitle else '' end",
    "'Req_ID: ' || Req_ID",
    f"'Type: ' || {NA('Requirement_Type')}",
    f"'Safety: ' || {NA('Safety')}",
    f"'Object_Number: ' || {NA('sect')}",
    "'Has_Rationale: ' || case when coalesce(Rationale, '') <> '' then 'true' else 'false' end",
    "'Is_Derived: ' || case when Is_Derived = 'yes' then 'true' else 'false' end",
    "''",
    "'### Requirement Statement'",
    "words",
    """case when length(words) < 100 then 'Additional context: ' || concat_ws('; ', 'Doc_Name: ' || Doc_Name, 'Section_Title: ' || nullif(rtitle, ''),
       'Object_Number: ' || nullif(sect, ''), 'Type: ' || nullif(Requirement_Type, ''), 'Safety: ' || nullif(Safety, '')) end""",
    "refs",
    "''",
    "'### Engineering Context'",
    "'Document: ' || Doc_Name",
    f"'Section_Title: ' || {NA('rtitle')}",
    "'Design_Note: N/A'",
    f"'Rationale: ' || {NA('Rationale')}",
    "'OLE_Title: N/A'",
    "''",
    "'### Traceability'",
    "'In-links: ' || coalesce(nullif(array_to_string(ins, ', '), ''), 'N/A')",
    "'Out-links: ' || coalesce(nullif(array_to_string(outs, ', '), ''), 'N/A')",
    "''",
    "'#### Linked Requirement Context (Injected)'",
    "coalesce(linked, '- N/A')",
)

BLOCKS_SQL = f"""{BLOCK_LINKED},
lk as (select row_idx as lrow, string_agg(case when side < 2 or not already then '- [' || tag || '] ' || rid || case when id is null then ': N/A' else ' (' || doc || ', ' || {NA('ttl')} || '): ' || snip end end, {NL} order by side, pos) as linked,
              string_agg(case when side = 2 then 'Referenced ' || rid || ': ' || snip end, {NL} order by side, pos) as refs from s group by 1),
bb as (select base.*, {sql_strip('(' + BODY + ')')} as words, coalesce(nullif(Object_Number, ''), Section_Number) as sect, linked, refs from base left join lk on lrow = row_idx),
blocks as (select row_idx, Req_ID, Doc_Name, Object_Number, trim({BLOCK}, '{BL}') as block from bb)"""

check("rag_blocks", f"with {BLOCKS_SQL} select * from blocks")(blocks)


BUCKETED = f"""{BLOCKS_SQL},
bk as (select *, coalesce(nullif(split_part(Object_Number, '-', 1), ''), 'N/A') as major from blocks),
bs as (select *, count(*) over (partition by Doc_Name, major) as n, row_number() over (partition by Doc_Name, major order by row_idx) as nth from bk),
bt as (select *, case when n <= 3 then major else major || '__part' || lpad(cast(cast(floor((nth - 1) / 3) as int) + 1 as varchar), 2, '0') end as bucket from bs)"""


@check(
    "merged_sections",
    f"""with {BUCKETED}
select Doc_Name as doc_slug, bucket, count(*) as blocks, Doc_Name || '__' || {SLUG.format('bucket')} || '.md' as file_name,
       trim(string_agg(block, {NL} || {NL} || '---' || {NL} || {NL} order by row_idx), '{BL}') || {NL} as content from bt group by Doc_Name, bucket""",
)
def _(spark, sf):
    return render.merged_sections(blocks(spark, sf), ORDER, max_per=3)


@check(
    "largest_buckets",
    f"""with {BUCKETED}, c as (select Doc_Name, bucket, count(*) as blocks from bt group by 1, 2),
r as (select *, row_number() over (partition by Doc_Name order by blocks desc, bucket) as rank from c)
select Doc_Name, bucket, blocks, rank from r where rank <= 5""",
)
def _(spark, sf):
    from tracegrid.operators.views import bucket_blocks

    return render.largest_buckets(bucket_blocks(blocks(spark, sf), ORDER, ["Doc_Name"], max_per=3))


@check(
    "block_size_stats",
    f"""with s as (select source, len(list_filter(regexp_split_to_array(text, '{BC}+'), lambda x: x <> '')) as w from documents)
select source, count(*) as blocks, round(avg(w), 6) as avg_words, cast(min(w) as int) as min_words, round(quantile_cont(w, 0.5), 6) as p50, round(quantile_cont(w, 0.9), 6) as p90,
       round(quantile_cont(w, 0.95), 6) as p95, cast(max(w) as int) as max_words from s group by 1""",
)
def _(spark, sf):
    stats = render.block_size_stats(fixture(spark, sf, "documents"), ["source"], "text")
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_words", "p50", "p90", "p95")})


ENTRY = J(
    "'### ' || Req_ID",
    "''",
    f"'#### Requirement Text' || {NL} || nullif(Requirement_Text, '') || {NL}",
    f"'#### Model' || {NL} || case when row_idx % 5 <> 0 then 'Model of ' || Req_ID end || {NL}",
    opt("**Parents:** ", "Parent_Req_IDs"),
    opt("**Children:** ", "Child_Req_IDs"),
    "case when coalesce(Parent_Req_IDs, '') <> '' or Child_Req_IDs <> '' then '' end",
    "'---'",
    "''",
)


@check(
    "printable_export",
    f"""with k as (select *, coalesce(nullif(regexp_extract(Object_Number, {NUM}, 1), ''), Object_Number) as key,
             coalesce(nullif(Section_Title, ''), nullif(Object_Number, ''), 'Ungrouped') as grp from reqs),
o as (select *, row_number() over (order by case when key = '' then 1 else 0 end, {_part('key', 1)}, {_part('key', 2)}, Req_ID, row_idx) as pos from k),
g as (select grp, min(pos) as first_pos, min_by(Object_Number, pos) as num from o group by 1),
lines as (
  select first_pos, 0 as kind, 0 as pos, '## ' || case when num <> '' then num || ' — ' || grp else grp end || {NL} as line from g
  union all select first_pos, 1, pos, {ENTRY} from o join g using (grp)),
placed as (select row_number() over (order by first_pos, kind, pos) as position, line from lines
           union all select 0, '# Requirements Export (Printable)' || {NL} || {NL} || '- Total: **' || count(*) || '**' || {NL} from reqs)
select cast(floor(position / 100) as int) + 1 as part, string_agg(line, {NL} order by position) as content from placed group by 1""",
)
def _(spark, sf):
    model = F.when(F.col("row_idx") % 5 != 0, F.concat(F.lit("# T\n## Model\nModel of "), "Req_ID", F.lit("\n## End")))
    return render.printable_export(reqs(spark, sf).withColumn("body", model), ORDER, "Model", "body", part_lines=100)


PATHS = """p as (select doc_id, lang, (doc_id % 9 + 1) || '.' || (doc_id % 4) as base, doc_id % 9 + 1 as top, doc_id % 3 as m from md_docs join documents using (doc_id))"""


def placed(spark, sf):
    md, docs = fixture(spark, sf, "md_docs"), fixture(spark, sf, "documents").select("doc_id", "lang")
    blanked = F.when(F.col("doc_id") % 3 == 0, F.replace("md", F.lit("Section_Number: "), F.lit("Other: "))).otherwise(F.col("md"))
    dashed = F.when(F.col("doc_id") % 3 == 1, F.replace("md", F.lit("Section_Number: "), F.lit("Object_Number: "))).otherwise(blanked)
    joined = md.join(docs, "doc_id").withColumn("md", dashed)
    return render.hierarchical_path(joined, F.col("lang"), F.col("md")).select("doc_id", "section", "folder")


@check(
    "hierarchical_path",
    f"""with {PATHS}
select doc_id, case when m = 2 then base || '-1' end as section, case when m = 2 then lang || '/' || top || '/' || base else lang || '/_unsectioned' end as folder from p""",
)
def _(spark, sf):
    return placed(spark, sf)


@check(
    "path_totals",
    f"with {PATHS} select count(*) as total, count(*) filter (where m = 2) as organized, count(*) filter (where m <> 2) as unsectioned from p",
)
def _(spark, sf):
    return render.path_totals(placed(spark, sf))


RULE = packaging.PackageRule(
    defaults={"source": "filesystem", "safety": "unclassified", "doc_name": "none"},
    name_patterns=[r"(?P<number>\d+)", r"(?P<first>\d)(?P<rest>\d*)"],
    companion=True,
)


@check(
    "package_documents",
    f"""with m as (select doc_id, path, md, doc_id || '.md' as name, regexp_replace(substr(md, strpos(md, '# Title')), '\\n\\z', '') as body,
    'FINGERPRINT::' || sha1(path) || sha1(md) as fp from md_docs),
t as (select *, {J("'<document_metadata>'", "'source: filesystem'", "'safety: unclassified'", "'doc_name: Doc ' || doc_id", "'number: ' || doc_id",
    "'first: ' || left(cast(doc_id as varchar), 1)", "'rest: ' || nullif(substr(cast(doc_id as varchar), 2), '')", "'tags: alpha'",
    "'Section_Number: ' || (doc_id % 9 + 1) || '.' || (doc_id % 4) || '-1'", "'filename: ' || name", "'fingerprint: ' || fp", "'</document_metadata>'")} as head from m),
d as (select *, head || {NL} || {NL} || '## Content' || {NL} || {NL} || body || {NL} || {NL} || fp as packaged from t),
c as (select *, 'Companion summary for ' || name || {NL} || {NL} || 'Fingerprint: ' || fp || {NL} || {NL} || 'Excerpt:' || {NL} || packaged as brief from d)
select path, packaged as text, fp as fingerprint, sha256(md) as original_sha256, 'document' as kind, sha256(packaged) as packaged_sha256, '' as title from c
union all select path, brief, fp, sha256(brief), 'summary', sha256(brief), doc_id || ' (summary)' from c""",
)
def _(spark, sf):
    done = packaging.package_documents(fixture(spark, sf, "md_docs"), "path", "md", RULE)
    return done.withColumn("title", F.coalesce(F.col("metadata")["title"], F.lit(""))).drop("metadata")
