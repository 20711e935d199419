"""Trace links between the normalised requirements."""

from pyspark.sql import functions as F

from tracegrid.checks import check
from tracegrid.checks.text import BL, sql_dedupe, sql_norm_id, sql_split_ids, sql_strip
from tracegrid.checks.views import reqs, tagged
from tracegrid.functions import ids as I
from tracegrid.operators import trace as t


@check(
    "req_index_lookup",
    f"""with ids as (select row_idx, unnest(list_concat({sql_split_ids('Parent_Req_IDs')}, {sql_split_ids('Child_Req_IDs')}, ['REQ-none'])) as link from reqs),
first as (select Req_ID, min_by(Requirement_Text, row_idx) as body, min_by(Doc_Name, row_idx) as doc from reqs group by 1)
select ids.row_idx, link, coalesce(nullif({sql_strip('body')}, ''), 'N/A') as linked_Requirement_Text, coalesce(nullif(doc, ''), 'N/A') as linked_Doc_Name
from ids left join first on link = Req_ID""",
)
def _(spark, sf):
    df = reqs(spark, sf)
    links = F.concat(I.split_ids("Parent_Req_IDs"), I.split_ids("Child_Req_IDs"), F.array(F.lit("REQ-none")))
    ids = df.select("row_idx", F.explode(links).alias("link"))
    return t.req_index_lookup(ids, "link", df, ["row_idx"], ["Requirement_Text", "Doc_Name"])


TITLES = """
titles as (select Section_Number as num, min_by(Section_Title, row_idx) as title from reqs where Section_Number <> '' and Section_Title <> '' group by 1)
"""

check("section_title_map", f"with {TITLES} select num as section, title from titles")(
    lambda spark, sf: t.section_titles(reqs(spark, sf), ["row_idx"])
)


def sql_links(c: str) -> str:
    found = f"regexp_extract_all(coalesce({c}, ''), '[A-Za-z]+-[0-9]+[A-Za-z0-9]*')"
    return f"{sql_dedupe(f'list_transform({found}, lambda x: ' + sql_norm_id('x') + ')')}"


# Every row points at its parents; inline ids come from the texts themselves.
LINKED = f"""
{TITLES},
base as (select r.*, coalesce(title, Section_Title) as rtitle, {sql_links('Parent_Req_IDs')} as ins, {sql_links('Child_Req_IDs')} as outs,
                {sql_links("'See REQ-3, alt-7 and ' || r.Req_ID || '. ' || Requirement_Text")} as inl from reqs r left join titles on Section_Number = num),
idx as (select Req_ID as id, min_by('See REQ-3, alt-7 and ' || Req_ID || '. ' || Requirement_Text, row_idx) as body, min_by(Doc_Name, row_idx) as doc, min_by(rtitle, row_idx) as ttl from base group by 1),
l as (
  select row_idx, 0 as side, generate_subscripts(ins, 1) as pos, 'in' as tag, unnest(ins) as rid from base
  union all select row_idx, 1, generate_subscripts(outs, 1), 'out', unnest(outs) from base
  union all select row_idx, 2, generate_subscripts(inl, 1), 'text', unnest(inl) from base),
f as (
  select l.*, id, doc, ttl, coalesce(nullif(trim(body, '{BL}'), ''), 'N/A') as b, list_contains(ins, rid) or list_contains(outs, rid) as already
  from l left join idx on rid = id join base using (row_idx)),
s as (select *, b as snip from f)
"""


def linked_reqs(spark, sf):
    body = F.concat(F.lit("See REQ-3, alt-7 and "), "Req_ID", F.lit(". "), "Requirement_Text")
    return t.with_section_title(reqs(spark, sf).withColumn("Requirement_Text", body), ["row_idx"])


@check(
    "link_context",
    f"""with {LINKED}
select base.row_idx, coalesce((select string_agg('- [' || tag || '] ' || rid || case when id is null then ': N/A' else
         ' (' || doc || ', ' || coalesce(nullif(trim(ttl, '{BL}'), ''), 'N/A') || '): ' || snip end, chr(10) order by side, pos)
       from s where s.row_idx = base.row_idx and (side < 2 or not already)), '') as linked,
       coalesce((select string_agg('Referenced ' || rid || ': ' || snip, chr(10) order by pos) from s where s.row_idx = base.row_idx and side = 2), '') as referenced
from base""",
)
def _(spark, sf):
    done = t.link_context(linked_reqs(spark, sf), ["row_idx"], F.col("Parent_Req_IDs"), F.col("Child_Req_IDs"))
    return done.select(
        "row_idx",
        F.array_join("linked_lines", "\n").alias("linked"),
        F.array_join("referenced_lines", "\n").alias("referenced"),
    )


def _resolved(name: str, column: str) -> str:
    return f"""
{name}_l as (select row_idx as page, generate_subscripts({sql_split_ids(column)}, 1) as pos, unnest({sql_split_ids(column)}) as rid from reqs),
{name} as (select page, row_number() over (partition by page order by pos) as rank, target from {name}_l join lastpage on rid = Req_ID)"""


GRAPH = f"""
lastpage as (select Req_ID, max(row_idx) as target from reqs group by 1),
{_resolved('par', 'Parent_Req_IDs')}, {_resolved('kid', 'Child_Req_IDs')},
cores as (select row_idx as core from reqs where Doc_Type <> 'SRS'),
p1 as (select core, target as near from par join cores on page = core),
c1 as (select core, target as near from kid join cores on page = core),
p2 as (select core, near, target as far from p1 join par on page = near),
c2 as (select core, near, target as far from c1 join kid on page = near)
"""


def graph(spark, sf):
    return t.trace_neighbourhood(
        reqs(spark, sf), "row_idx", depth=2, core=F.col("Doc_Type") != "SRS"
    )


@check(
    "trace_nodes",
    f"""with {GRAPH}
select core || '|core' as node_id, core as page, 'core' as role from cores
union select near || '|parent:' || core, near, 'parent' from p1 union select near || '|child:' || core, near, 'child' from c1
union select far || '|grandparent:' || near, far, 'grandparent' from p2 union select far || '|grandchild:' || near, far, 'grandchild' from c2""",
)
def _(spark, sf):
    return graph(spark, sf)[0]


@check(
    "trace_edges",
    f"""with {GRAPH}
select near || '|parent:' || core as source, core || '|core' as target from p1 union select core || '|core', near || '|child:' || core from c1
union select far || '|grandparent:' || near, near || '|parent:' || core from p2 union select near || '|child:' || core, far || '|grandchild:' || near from c2""",
)
def _(spark, sf):
    return graph(spark, sf)[1]


@check(
    "related_with_block",
    f"""with {GRAPH},
cand as (select row_idx as core, row_idx as page, 0 as side, 0 as rank from reqs union all select page, target, 1, rank from par union all select page, target, 2, rank from kid),
once as (select core, page, min((side, rank)) as place from cand group by 1, 2),
holds as (select row_idx, Req_ID from reqs where row_idx % 5 <> 0 and {sql_strip('Requirement_Text')} <> ''
          and not regexp_matches(Requirement_Text, '^\\s*#{{1,2}}\\s'))
select core, page, Req_ID, row_number() over (partition by core order by place) as position, row_number() over (partition by core order by place) <= 2 as shown
from once join holds on page = row_idx""",
)
def _(spark, sf):
    heading = F.when(F.col("row_idx") % 5 == 0, F.lit("## Other\n")).otherwise(F.lit("## Model Block\n"))
    body = F.concat(F.lit("# Title\n"), heading, "Requirement_Text", F.lit("\n## End"))
    return t.related_with_block(reqs(spark, sf).withColumn("body", body), "row_idx", "body", "Model block", "both", cap=2)


@check(
    "parent_tags",
    f"""with {GRAPH}, tags as (select row_idx, 1 as tp, 'old' as tag from reqs where row_idx % 3 < 2 union all select row_idx, 2, 'review' from reqs where row_idx % 3 = 0),
firsts as (select page, tag, min((rank, tp)) as place from par join tags on target = row_idx group by 1, 2)
select page as row_idx, string_agg(tag, '|' order by place) as parent_tags from firsts group by 1""",
)
def _(spark, sf):
    done = t.parent_tags(tagged(spark, sf), "row_idx")
    return done.select("row_idx", F.array_join("parent_tags", "|").alias("parent_tags"))
