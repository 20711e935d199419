"""Blocks, chunks and their metadata over every document."""

from pyspark.sql import functions as F

from tracegrid.checks import check
from tracegrid.checks.text import BL, sql_strip
from tracegrid.fixtures import fixture
from tracegrid.operators import chunks as c

def sql_cut(source: str, keys: str) -> str:
    """The chunking rule as a recursive query over (keys, t): one step per fragment."""

    def end(at: str) -> str:
        window = f"translate(substr(t, {at} + 1, 1200), chr(10), ' ')"
        soft = f"1200 - strpos(reverse({window}), ' ') + 1"
        return (
            f"cast(case when length(t) <= {at} + 1200 then length(t) when contains({window}, ' ') and {soft} > 200 "
            f"then {at} + {soft} else {at} + 1200 end as bigint)"
        )

    return f"""cut as (
  select {keys}, t, 0 as idx, cast(0 as bigint) as s, {end('0')} as e from {source} where t <> ''
  union all select {keys}, t, idx + 1, e - 200, {end('(e - 200)')} from cut where e < length(t)),
pieces as (select {keys}, idx, trim(substr(t, s + 1, e - s), '{BL}') as chunk, cast(s as int) as s, cast(e as int) as e from cut)"""


@check(
    "chunk_text",
    f"""with recursive src as (select doc_id, {sql_strip('text')} as t from documents),
{sql_cut('src', 'doc_id')}
select doc_id, idx as chunk_index, chunk, s as start_char, e as end_char from pieces""",
)
def _(spark, sf):
    return c.chunk_text(fixture(spark, sf, "documents").select("doc_id", "text"), "text")


@check(
    "front_matter",
    """select doc_id, 'Doc ' || doc_id as doc_name, 'alpha' as tags, (doc_id % 9 + 1) || '.' || (doc_id % 4) || '-1' as section,
       regexp_replace(substr(md, strpos(md, '# Title')), '\\n\\z', '') as body from md_docs""",
)
def _(spark, sf):
    front, body = c.front_matter("md")
    return fixture(spark, sf, "md_docs").select(
        "doc_id",
        front["doc_name"].alias("doc_name"),
        front["tags"].alias("tags"),
        front["Section_Number"].alias("section"),
        body.alias("body"),
    )


# The blocks of the documents, written out from the pieces they are made of.
BLOCKS = """
raw as (select doc_id, path, md, '# Title ' || doc_id || chr(10) || 'Req_ID: REQ-' || doc_id || chr(10) || 'Object_Number: 2.' || (doc_id % 9) || chr(10) || text as p0,
               '## Part two' || chr(10) || text || chr(10) || '### Deep' || chr(10) || 'x' as p1, '# Last' || chr(10) || 'tail' as p2
        from md_docs join documents using (doc_id)),
spans as (
  select doc_id, path, md, 0 as n, p0 as body, 'Title ' || doc_id as head, 'Title ' || doc_id as trail, 0 as s, length(p0) + 1 as e from raw
  union all select doc_id, path, md, 1, p1, 'Deep', 'Title ' || doc_id || ' > Part two > Deep', length(p0) + 5, length(p0) + length(p1) + 6 from raw
  union all select doc_id, path, md, 2, p2, 'Last', 'Last', length(p0) + length(p1) + 14, length(p0) + length(p1) + length(p2) + 15 from raw)
"""


@check(
    "markdown_blocks",
    f"""with {BLOCKS} select doc_id, trim(body, '{BL}') as block, trail as heading_path, head as heading_text, cast(s as int) as start_char,
       cast(e as int) as end_char, n as index from spans""",
)
def _(spark, sf):
    return c.markdown_blocks(fixture(spark, sf, "md_docs").select("doc_id", "md"), "md")


def _first(*patterns: str, within: tuple[str, ...] = ("body", "head")) -> str:
    """The first match in the body, else in the heading."""
    found = [f"nullif(regexp_extract({c}, '{p}', 1), '')" for c in within for p in patterns]
    return f"coalesce({', '.join(found)})"


REQ = (
    r"(?mi)^Req_ID:\s*([A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*-\d{1,6}[A-Za-z0-9_-]*)",
    r"(?mi)^##\s*([A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*-\d{1,6}[A-Za-z0-9_-]*)",
    r"([A-Za-z]{2,}[A-Za-z0-9_-]*-\d{2,7}[A-Za-z0-9_-]*)",
)
OBJ = (
    r"(?mi)^Object_Number:\s*(\d+(?:\.\d+)*(?:[-/][A-Za-z0-9]+)?)",
    r"(?mi)^Section:\s*(\d+(?:\.\d+)*(?:[-/][A-Za-z0-9]+)?)",
)
SEC = (
    r"(?mi)^Section:\s*(\d+(?:\.\d+){0,4})",
    r"(?mi)^Object_Number:\s*(\d+(?:\.\d+){0,4})",
    r"(\d+(?:\.\d+){1,4})",
)


LEVEL = " ".join(
    f"when regexp_matches({c}, '(?i)\\b{w}\\b') then '{w}'" for c in ("trail", "body", "chunk") for w in ("System", "HLR", "LLR")
)


@check(
    "chunk_documents",
    f"""with recursive {BLOCKS},
src as (select doc_id, path, md, n, head, trail, s as block_start, trim(body, '{BL}') as body, trim(body, '{BL}') as t from spans),
{sql_cut('src', 'doc_id, path, md, n, head, trail, block_start, body')},
placed as (select *, row_number() over (partition by doc_id order by n, idx) - 1 as pos, sha256(string_agg(chunk, chr(10) || chr(10)) over (partition by doc_id
             order by n, idx rows between unbounded preceding and unbounded following)) as content from pieces)
select path as source_path, doc_id || '.md' as file_name, '.md' as file_ext, 'md' as doc_type, 'Doc ' || doc_id as doc_name, 'alpha' as tags,
       cast(pos as int) as chunk_index, chunk as text, trail as heading_path, block_start + s as start_char, block_start + e as end_char,
       {_first(*REQ, within=('body', 'head', 'chunk'))} as req_id, {_first(*OBJ, within=('body', 'head', 'chunk'))} as object_number,
       {_first(*SEC, within=('body', 'head', 'chunk'))} as section_id, case {LEVEL} end as doc_level, sha256(md) as doc_sha256, sha256(chunk) as chunk_sha256,
       content as content_sha256, (doc_id % 9 + 1) || '.' || (doc_id % 4) || '-1' as front_section, 'Section_Number' as extra_keys,
       substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(u, 17, 1)) - 1) % 4 + 1, 1)
         || substr(u, 18, 3) || '-' || substr(u, 21, 12) as id
from (select *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(path || '::' || pos)) as u from placed)""",
)
def _(spark, sf):
    done = c.chunk_documents(fixture(spark, sf, "md_docs"), "path", "md")
    section = F.col("extra")["Section_Number"].alias("front_section")
    keys = F.array_join(F.array_sort(F.map_keys("extra")), ",").alias("extra_keys")
    return done.select("*", section, keys).drop("extra", "ingest_timestamp_utc")


@check(
    "regex_metadata",
    f"""with t as (select doc_id, case when doc_id % 2 = 0 then text else md end as body, 'Part A-12 of 3.4' as head,
                  case when doc_id % 5 = 0 then 'x > system y' else 'top' end as path from md_docs join documents using (doc_id))
select doc_id, {_first(*REQ)} as req_id, {_first(*OBJ)} as object_number, {_first(*SEC)} as section_id,
       case when regexp_matches(path, '(?i)\\bsystem\\b') then 'System' when regexp_matches(body, '(?i)\\bsystem\\b') then 'System'
            when regexp_matches(body, '(?i)\\bhlr\\b') then 'HLR' when regexp_matches(body, '(?i)\\bllr\\b') then 'LLR' end as doc_level
from t""",
)
def _(spark, sf):
    md, docs = fixture(spark, sf, "md_docs"), fixture(spark, sf, "documents")
    body = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("md"))
    path = F.when(F.col("doc_id") % 5 == 0, "x > system y").otherwise("top")
    meta = c.regex_metadata(body, F.lit("Part A-12 of 3.4"), path)
    return md.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", *[e.alias(n) for n, e in meta.items()])


@check(
    "heading_at_offset",
    """with h as (select l_suppkey as doc, cast(l_orderkey * 10 as bigint) as pos, max(l_returnflag || l_linestatus) as heading_path from lineitem where l_linenumber = 3 group by 1, 2),
ch as (select distinct l_suppkey as doc, cast(l_orderkey * 10 + l_linenumber - 4 as bigint) as start_char from lineitem)
select ch.doc, ch.start_char, coalesce((select max_by(heading_path, pos) from h where h.doc = ch.doc and pos <= start_char),
       (select min_by(heading_path, pos) from h where h.doc = ch.doc), '') as heading_path from ch""",
)
def _(spark, sf):
    lines = fixture(spark, sf, "lineitem")
    headings = lines.where("l_linenumber = 3").groupBy(
        F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10).alias("pos")
    ).agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("heading_path"))
    starts = lines.select(
        F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") - 4).alias("start_char")
    ).distinct()
    return c.heading_at_offset(starts, headings, "doc", "start_char", "pos")


@check(
    "parse_pipe_tables",
    """with l as (select o_orderkey, string_agg('| ' || l_linenumber || ' |' || l_quantity || '|', chr(10) order by l_linenumber, l_quantity) as body
            from lineitem join orders on l_orderkey = o_orderkey group by 1),
numbered as (select o_orderkey, l_linenumber, l_quantity, row_number() over (partition by o_orderkey order by l_linenumber, l_quantity) - 1 as rn
             from lineitem join orders on l_orderkey = o_orderkey)
select o_orderkey, 0 as table_index, 'line|qty' as headers, cast(rn as int) as row_index, l_linenumber || '|' || l_quantity as cells from numbered""",
)
def _(spark, sf):
    lines = fixture(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity"))
    orders = fixture(spark, sf, "orders").select("o_orderkey")
    row = F.concat(
        F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" |"), F.col("l_quantity").cast("string"), F.lit("|")
    )
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", row.alias("row")))), lambda x: x["row"]),
        "\n",
    )
    docs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(body.alias("body"))
    text = F.concat(F.lit("intro\n| line | qty |\n|---|:--|\n"), "body", F.lit("\n\nafter | no table"))
    done = c.parse_pipe_tables(docs.select("o_orderkey", text.alias("md")), "md")
    return done.withColumn("headers", F.array_join("headers", "|")).withColumn("cells", F.array_join("cells", "|"))
