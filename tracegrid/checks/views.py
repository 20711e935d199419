"""Filters, groupings, orders and summaries over the normalised requirements."""

from pyspark.sql import functions as F

from tracegrid.checks import check
from tracegrid.checks.text import BC, BL, sql_strip
from tracegrid.fixtures import fixture
from tracegrid.functions.text import clean_str, slugify
from tracegrid.operators import ordered, views as v


def reqs(spark, sf):
    return fixture(spark, sf, "reqs")


@check("wildcard_filter", "select row_idx, Req_ID from reqs where regexp_matches(Req_ID, '(?i)q-0.*1') or regexp_matches(coalesce(Safety, ''), '(?i)q-0.*1')")
def _(spark, sf):
    return v.wildcard_filter(reqs(spark, sf), ["Req_ID", "Safety"], "q-0*1").select("row_idx", "Req_ID")


@check(
    "viewer_filter",
    """select row_idx, Req_ID from reqs
where Doc_Type = 'FCSS' and Level = 'System_High' and coalesce(Requirement_Type, Section_Type) in ('', 'Header', 'Requirement')
  and (regexp_matches(case when trim(Object_Number) <> '' then trim(Object_Number) else trim(Section_Number) end, '(?i)1.*2') or regexp_matches(Section_Title, '(?i)1.*2'))
  and regexp_matches(Req_ID, '(?i)req') and regexp_matches(Requirement_Text, '(?i)a.*e')""",
)
def _(spark, sf):
    return v.viewer_filter(
        reqs(spark, sf),
        doc_type="FCSS",
        level="System_High",
        req_types=["", "Header", "Requirement"],
        section="1*2",
        req_id="req",
        global_text="a*e",
        body_col="Requirement_Text",
    ).select("row_idx", "Req_ID")


TITLE = f"trim(regexp_replace(Section_Title, '{BC}+', ' ', 'g'), '{BL}')"
NUM = "'^([0-9]+(?:[.][0-9]+)*)\\b'"


def _part(c: str, i: int) -> str:
    return f"coalesce(try_cast(regexp_extract(split_part({c}, '.', {i}), '^([0-9]+)', 1) as int), 0)"


# Sort keys written out part by part: the input has section numbers of two parts.
KEYED = f"""
keyed as (
  select *, {TITLE} as title, coalesce(nullif(trim(Object_Number), ''), nullif(regexp_extract({TITLE}, {NUM}, 1), ''), Req_ID) as k0 from reqs),
numbered as (select *, coalesce(nullif(regexp_extract(k0, {NUM}, 1), ''), k0) as k, regexp_extract(title, {NUM}, 1) as tnum from keyed)
"""


@check(
    "section_sort",
    f"with {KEYED} select row_idx, row_number() over (order by {_part('k', 1)}, {_part('k', 2)}, Req_ID, row_idx) as position from numbered",
)
def _(spark, sf):
    df = reqs(spark, sf)
    keyed = df.select("row_idx", "Req_ID", v.page_sort_key(df).alias("key"))
    return ordered.row_number(keyed, ["key", "Req_ID", "row_idx"], "position").select("row_idx", "position")


@check(
    "section_groups",
    f"""with {KEYED},
entries as (
  select case when title = '' then 'Unsectioned' else title end as group_title, tnum, 'page' as entry, 1 as kind,
         {_part('k', 1)} as a, {_part('k', 2)} as b, Req_ID, row_idx from numbered
  union all
  select distinct case when title = '' then 'Unsectioned' else title end, tnum, 'group', 0, -1, -1, '', -1 from numbered)
select row_number() over (order by case when tnum = '' then 1 else 0 end, {_part('tnum', 1)}, {_part('tnum', 2)}, group_title, kind, a, b, Req_ID, row_idx) as queue_position,
       entry, group_title, Req_ID from entries""",
)
def _(spark, sf):
    return v.section_groups(reqs(spark, sf), ["row_idx"])


@check("page", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def _(spark, sf):
    df = fixture(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    descending = df.withColumn("falling", -F.col("o_totalprice"))
    return v.page(descending, ["falling", "o_orderkey"], 50, 3)[0].drop("falling")


@check(
    "section_outline",
    """with t as (select *, case when split_part(Object_Number, '.', 1) <> '' then split_part(Object_Number, '.', 1) else split_part(Object_Number, '-', 1) end as section
           from reqs where Doc_Type = 'FCSS' and Object_Number <> '')
select row_number() over (order by cast(section as int), section, Object_Number, row_idx) as position, section,
       (len(string_split(Object_Number, '.')) - 1) * 2 as indent, Object_Number, Req_ID, Section_Title, Is_Section_Header from t""",
)
def _(spark, sf):
    return v.section_outline(reqs(spark, sf), "FCSS", ["row_idx"])


MEMBERS = f"""
m as (select *, split_part(Section_Number, '-', 1) as base, {sql_strip('Requirement_Text')} as body,
             trim(regexp_replace(Requirement_Text, '{BC}+', ' ', 'g'), '{BL}') as line from reqs),
keyed as (
  select row_idx, Req_ID, Doc_Name, Doc_Type, base, line, case when Object_Number = '' then 1 else 0 end as noobj,
         {_part('Object_Number', 1)} as a, {_part('Object_Number', 2)} as b,
         coalesce(try_cast(split_part(Object_Number, '-', 2) as int), -1) as c
  from m where base <> '' and not Is_Section_Header and body <> ''),
w as (
  select row_idx, lag(Req_ID) over o as p1, lag(Req_ID, 2) over o as p2, lead(Req_ID) over o as n1, lead(Req_ID, 2) over o as n2, lag(line) over o as pl, lead(line, 2) over o as nl
  from keyed window o as (partition by Doc_Name, Doc_Type, base order by noobj, a, b, c, lower(Req_ID), row_idx))
"""


@check(
    "neighbours",
    f"""with {MEMBERS}
select r.row_idx, coalesce(concat_ws(',', p1, p2), '') as prev_ids, coalesce(concat_ws(',', n1, n2), '') as next_ids,
       coalesce(pl, '') as nearest_text, coalesce(nl, '') as second_next_text
from reqs r left join w on r.row_idx = w.row_idx""",
)
def _(spark, sf):
    done = v.section_neighbours(reqs(spark, sf), ["row_idx"])

    def ids(c):
        return F.array_join(F.transform(c, lambda x: x["id"]), ",")

    def line(c, i):
        return F.coalesce(F.get(F.col(c), F.lit(i))["text"], F.lit(""))

    return done.select(
        "row_idx",
        ids("prev").alias("prev_ids"),
        ids("next").alias("next_ids"),
        line("prev", 0).alias("nearest_text"),
        line("next", 1).alias("second_next_text"),
    )


# Stems that repeat, and stems that look like generated names of others.
STEMS = """
s as (select row_idx, Doc_Name, case when row_idx % 3 = 0 then split_part(Object_Number, '-', 1) when row_idx % 3 = 1 then Object_Number
             else split_part(Object_Number, '.', 1) || '-2' end as stem from reqs)
"""


@check(
    "unique_names",
    f"""with {STEMS},
n as (select *, row_number() over (partition by Doc_Name, stem order by row_idx) - 1 as j from s),
stems as (select distinct Doc_Name, stem from s),
free as (
  select d.Doc_Name, d.stem, i.k, row_number() over (partition by d.Doc_Name, d.stem order by i.k) as j
  from (select distinct Doc_Name, stem from n where j > 0) d, (select unnest(range(1, (select max(j) + count(*) from n))) as k) i
  where not exists (select 1 from stems x where x.Doc_Name = d.Doc_Name and x.stem = d.stem || '-' || i.k))
select n.row_idx, n.Doc_Name, n.stem, case when n.j = 0 then n.stem else n.stem || '-' || f.k end as unique_name
from n left join free f on n.Doc_Name = f.Doc_Name and n.stem = f.stem and n.j = f.j""",
)
def _(spark, sf):
    number = F.col("Object_Number")
    stem = (
        F.when(F.col("row_idx") % 3 == 0, F.split_part(number, F.lit("-"), F.lit(1)))
        .when(F.col("row_idx") % 3 == 1, number)
        .otherwise(F.concat(F.split_part(number, F.lit("."), F.lit(1)), F.lit("-2")))
    )
    df = reqs(spark, sf).select("row_idx", "Doc_Name", stem.alias("stem"))
    return v.unique_names(df, ["Doc_Name"], F.col("stem"), ["row_idx"])


# Numbers of one, two and three parts, so that buckets of every kind appear.
NUMBERED = """
o as (select row_idx, Doc_Type, case when row_idx % 5 = 0 then split_part(Object_Number, '.', 1) when row_idx % 5 < 3 then Object_Number
             else split_part(Object_Number, '-', 1) || '.' || (row_idx % 5) end as num from reqs)
"""


@check(
    "bucket_blocks",
    f"""with {NUMBERED},
t as (select *, case when regexp_matches(num, '[0-9]+([.][0-9]+)+') then regexp_extract(num, '[0-9]+([.][0-9]+)+') else regexp_extract(num, '[0-9]+') end as tgt from o),
k as (select *, case when tgt = '' then 'N/A' else array_to_string(string_split(tgt, '.')[1:2], '.') end as major,
             case when len(string_split(tgt, '.')) >= 3 then array_to_string(string_split(tgt, '.')[1:3], '.') else 'N/A' end as minor from t),
f as (select *, case when minor <> 'N/A' then minor else major end as finer, count(*) over (partition by Doc_Type, major) as nmaj from k),
p as (select *, count(*) over (partition by Doc_Type, major, finer) as nmin, row_number() over (partition by Doc_Type, major, finer order by row_idx) as nth from f)
select row_idx, case when nmaj <= 5 then major when nmin <= 5 then finer
       else finer || '__part' || lpad(cast(cast(floor((nth - 1) / 5) as int) + 1 as varchar), 2, '0') end as bucket from p""",
)
def _(spark, sf):
    number = F.col("Object_Number")
    short = (
        F.when(F.col("row_idx") % 5 == 0, F.split_part(number, F.lit("."), F.lit(1)))
        .when(F.col("row_idx") % 5 < 3, number)
        .otherwise(
            F.concat(F.split_part(number, F.lit("-"), F.lit(1)), F.lit("."), (F.col("row_idx") % 5).cast("string"))
        )
    )
    df = reqs(spark, sf).select("row_idx", "Doc_Type", short.alias("Object_Number"))
    return v.bucket_blocks(df, ["row_idx"], ["Doc_Type"], max_per=5).select("row_idx", "bucket")


@check(
    "doc_type_summary",
    "select Doc_Type, count(*) as total, count(nullif(Section_Title, '')) as with_section from reqs group by 1",
)
def _(spark, sf):
    return v.doc_type_summary(reqs(spark, sf))


@check(
    "section_coverage",
    "select Section_Title, Doc_Type, count(*) as requirements from reqs where Section_Title <> '' group by 1, 2 order by 3 desc, 1, 2 limit 20",
)
def _(spark, sf):
    return v.section_coverage(reqs(spark, sf))


@check(
    "section_stats",
    """select Doc_Type || ' - ' || Section_Title as section, count(*) filter (where Is_Section_Header) as headers,
       count(*) filter (where not Is_Section_Header) as requirements, count(*) as total from reqs where Section_Title <> '' group by 1""",
)
def _(spark, sf):
    return v.section_stats(reqs(spark, sf))


@check(
    "section_rollup",
    """with n as (select *, row_number() over (partition by Section_Title, Object_Number order by Req_ID, row_idx) as rn,
             count(*) over (partition by Section_Title, Object_Number) as total from reqs where Doc_Type = 'FCSRD' and Section_Title <> '')
select Section_Title, Object_Number, cast(floor((rn - 1) / 2) as int) + 1 as part, count(*) as requirements_in_part, min(total) as total,
       string_agg(Req_ID, '|' order by rn) as requirements from n group by 1, 2, 3""",
)
def _(spark, sf):
    done = v.section_rollup(reqs(spark, sf), "FCSRD", ["row_idx"], list_part=2)
    return done.withColumn("requirements", F.array_join("requirements", "|"))


@check(
    "distinct_values",
    """select distinct 'Doc_Type' as column_name, Doc_Type as value from reqs union select 'Level', Level from reqs
union select 'Safety', Safety from reqs where Safety <> '' union select 'Section_Title', Section_Title from reqs where Section_Title <> ''""",
)
def _(spark, sf):
    return v.distinct_values(reqs(spark, sf), ["Doc_Type", "Level", "Safety", "Section_Title"])


LABEL = "case when Is_Section_Header then 'Header' else 'Requirement' end as label"


@check("all_requirements", f"select Req_ID, Doc_Type, Section_Title, Object_Number, {LABEL}, Level from reqs")
def _(spark, sf):
    return v.all_requirements(reqs(spark, sf))


@check(
    "by_doc_type",
    f"select Req_ID, Doc_Type, Section_Title, Object_Number, {LABEL} from reqs where Doc_Type = 'FCSRD' or Doc_Type = 'CCSRD'",
)
def _(spark, sf):
    return v.by_doc_type(reqs(spark, sf), ["FCSRD", "CCSRD"])


@check("by_level", "select Req_ID, Doc_Type, Level, Section_Title from reqs where Level like '%System%' or Level like '%High%'")
def _(spark, sf):
    return v.by_level(reqs(spark, sf), ["System", "High"])


@check("section_headers", "select Req_ID, Doc_Type, Section_Title, Object_Number from reqs where Is_Section_Header")
def _(spark, sf):
    return v.section_headers(reqs(spark, sf))


@check(
    "section_headers_stated",
    "select Req_ID, Doc_Type, Section_Title, Object_Number from reqs where Is_Section_Header and not Section_Inferred",
)
def _(spark, sf):
    return v.section_headers(reqs(spark, sf), inferred=False)


LINKS = "select Req_ID, Doc_Type, Section_Title, Parent_Req_IDs, Child_Req_IDs from reqs where"

check("with_parents", f"{LINKS} coalesce(Parent_Req_IDs, '') <> ''")(lambda s, sf: v.by_links(reqs(s, sf), parents=True))
check("with_children", f"{LINKS} coalesce(Child_Req_IDs, '') <> ''")(lambda s, sf: v.by_links(reqs(s, sf), children=True))
check("without_parents", f"{LINKS} coalesce(Parent_Req_IDs, '') = ''")(lambda s, sf: v.by_links(reqs(s, sf), parents=False))
check("orphans", f"{LINKS} coalesce(Parent_Req_IDs, '') = '' and coalesce(Child_Req_IDs, '') = ''")(
    lambda s, sf: v.by_links(reqs(s, sf), parents=False, children=False)
)


@check(
    "by_section_term",
    f"select Req_ID, Section_Title, Object_Number, {LABEL}, Parent_Req_IDs from reqs where contains(Section_Title, 'Scope')",
)
def _(spark, sf):
    return v.by_section_term(reqs(spark, sf), "Scope")


@check(
    "browse_by_section",
    f"""select row_number() over (order by Section_Title, Object_Number, row_idx) as position, Section_Title, Req_ID,
       case when Object_Number = '' then '—' else Object_Number end as Object_Number, {LABEL} from reqs where Section_Title <> ''""",
)
def _(spark, sf):
    return v.browse_by_section(reqs(spark, sf), ["row_idx"])


def tagged(spark, sf):
    tags = F.when(F.col("row_idx") % 3 == 0, F.array(F.lit("old"), F.lit("review"))).when(
        F.col("row_idx") % 3 == 1, F.array(F.lit("old"))
    )
    return reqs(spark, sf).select("row_idx", "Doc_Type", "Safety", "Parent_Req_IDs", "Req_ID", tags.alias("tags"))


@check(
    "bulk_tag",
    """select row_idx, concat_ws('|', case when row_idx % 3 < 2 then 'old' end, case when row_idx % 3 = 0 then 'review' end,
       case when row_idx % 3 <> 0 and Doc_Type = 'FCSS' then 'review' end) as tags from reqs""",
)
def _(spark, sf):
    done, _ = v.bulk_tag(tagged(spark, sf), F.col("Doc_Type") == "FCSS", "review")
    return done.select("row_idx", F.array_join("tags", "|").alias("tags"))


@check("bulk_tag_count", "select count(*) as updated from reqs where Doc_Type = 'FCSS' and row_idx % 3 <> 0")
def _(spark, sf):
    return v.bulk_tag(tagged(spark, sf), F.col("Doc_Type") == "FCSS", "review")[1]


@check("bulk_note", "select row_idx, case when Safety = 'en' then 'check' else Rationale end as notes from reqs")
def _(spark, sf):
    df = reqs(spark, sf).select("row_idx", "Safety", F.col("Rationale").alias("notes"))
    return v.bulk_note(df, F.col("Safety") == "en", "check")[0].drop("Safety")


@check("bulk_note_count", "select count(*) as updated from reqs where Safety = 'en'")
def _(spark, sf):
    return v.bulk_note(reqs(spark, sf), F.col("Safety") == "en", "check")[1]
