"""Scalar functions over the requirement and document texts."""

from pyspark.sql import functions as F

from tracegrid.checks import check
from tracegrid.fixtures import fixture
from tracegrid.functions import ids as I
from tracegrid.functions import text as X

# Blank characters as SQL text, and as a regex class.
BL = X.BLANKS
BC = X.BLANK_CLASS


def sql_strip(c: str) -> str:
    return f"trim(coalesce({c}, ''), '{BL}')"


def sql_norm_id(c: str) -> str:
    """One id token in normal form, written with captures and ``lpad``."""
    t = f"regexp_replace({c}, '{BC}+', '', 'g')"
    shape = "'^([A-Za-z]+)-0*([0-9]+)([A-Za-z]*)$'"
    num = f"regexp_extract({t}, {shape}, 2)"
    return (
        f"case when regexp_matches({t}, {shape}) then upper(regexp_extract({t}, {shape}, 1)) || '-' || "
        f"case when length({num}) < 5 then lpad({num}, 5, '0') else {num} end || upper(regexp_extract({t}, {shape}, 3)) else {t} end"
    )


def sql_split_ids(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[\n;,]'), lambda x: trim(x, '{BL}')), lambda x: x <> '')"


def sql_dedupe(c: str) -> str:
    """A list without repeats, first places kept."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def sql_parse_ids(c: str) -> str:
    return sql_dedupe(f"list_transform({sql_split_ids(c)}, lambda x: {sql_norm_id('x')})")


@check("normalize_req_id", f"select d, {sql_norm_id('req')} as norm, {sql_norm_id('up2')} as norm_up from req_rows")
def _(spark, sf):
    df = fixture(spark, sf, "req_rows")
    return df.select("d", I.normalize_req_id("req").alias("norm"), I.normalize_req_id("up2").alias("norm_up"))


@check(
    "split_ids",
    f"""select d, array_to_string({sql_split_ids('req')}, '|') as tokens,
       array_to_string({sql_parse_ids("req || ';' || coalesce(up, '') || ';' || up2")}, '|') as parsed,
       coalesce(list_transform({sql_split_ids('req')}, lambda x: {sql_norm_id('x')})[1], '') as primary_id,
       array_to_string(list_transform({sql_split_ids('req')}, lambda x: {sql_norm_id('x')})[2:], ', ') as aliases
from req_rows""",
)
def _(spark, sf):
    df = fixture(spark, sf, "req_rows")
    several = F.concat("req", F.lit(";"), F.coalesce("up", F.lit("")), F.lit(";"), "up2")
    return df.select(
        "d",
        F.array_join(I.split_ids("req"), "|").alias("tokens"),
        F.array_join(I.parse_id_list(several), "|").alias("parsed"),
        I.primary_id("req").alias("primary_id"),
        I.alias_ids("req").alias("aliases"),
    )


LINK_TEXT = "'Primary= ' || req || ' also ' || coalesce(up, 'none') || ' and X-12a ' || body"


@check(
    "extract_link_ids",
    f"""with t as (select d, {LINK_TEXT} as t, case when d % 3 = 0 then 'n/a' else up end as u from req_rows),
found as (select d, list_concat(regexp_extract_all(t, 'Primary\\\\?=\\s*([A-Za-z]+-[0-9]+[A-Za-z0-9]*)', 1),
                                regexp_extract_all(t, '([A-Za-z]+-[0-9]+[A-Za-z0-9]*)', 1)) as f,
                 regexp_extract_all(u, '[A-Za-z]+-[0-9]+[A-Za-z0-9]*') as g from t),
n as (select d, list_transform(f, lambda x: {sql_norm_id('x')}) as f, list_transform(g, lambda x: {sql_norm_id('x')}) as g from found)
select d, array_to_string({sql_dedupe('f')}, '|') as links, array_to_string(coalesce({sql_dedupe('g')}, []), '|') as few from n""",
)
def _(spark, sf):
    df = fixture(spark, sf, "req_rows")
    body = F.concat(
        F.lit("Primary= "), "req", F.lit(" also "), F.coalesce("up", F.lit("none")), F.lit(" and X-12a "), "body"
    )
    few = F.when(F.col("d") % 3 == 0, F.lit("n/a")).otherwise(F.col("up"))
    return df.select(
        "d",
        F.array_join(I.extract_link_ids(body), "|").alias("links"),
        F.array_join(I.extract_link_ids(few), "|").alias("few"),
    )


@check(
    "make_srs_req_id",
    "select d, 'SRS-' || replace(replace(sec || '/a b', ' ', ''), '/', '_') || '-' || replace(num || ' x', ' ', '') as req_id from srs_rows",
)
def _(spark, sf):
    df = fixture(spark, sf, "srs_rows")
    return df.select(
        "d", I.make_srs_req_id(F.concat("sec", F.lit("/a b")), F.concat("num", F.lit(" x"))).alias("req_id")
    )


@check(
    "slugify",
    """with s as (select d, trim(regexp_replace(body, '[^A-Za-z0-9_.-]+', '_', 'g'), '._-') as b,
       trim(regexp_replace(req, '[^A-Za-z0-9_.-]+', '_', 'g'), '._-') as r from req_rows)
select d, case when b = '' then 'item' else b end as body_slug, case when r = '' then 'item' else r end as req_slug from s""",
)
def _(spark, sf):
    df = fixture(spark, sf, "req_rows")
    return df.select("d", X.slugify("body").alias("body_slug"), X.slugify("req").alias("req_slug"))


@check(
    "section_keys",
    """with n as (select d, coalesce(num, '') as num, split_part(coalesce(num, ''), '-', 1) as base,
       case when d % 3 = 0 then 'Sec ' || coalesce(num, '') || '.7.9' when d % 3 = 1 then 'v' || d else num end as obj from req_rows),
t as (select *, replace(coalesce(obj, ''), ' ', '') as o from n),
k as (select *, case when regexp_matches(o, '[0-9]+([.][0-9]+)+') then regexp_extract(o, '[0-9]+([.][0-9]+)+')
                     else regexp_extract(o, '[0-9]+') end as tgt from t)
select d, trim(base) as section_base,
       case when tgt = '' then 'N/A' else array_to_string(string_split(tgt, '.')[1:2], '.') end as major,
       case when len(string_split(tgt, '.')) >= 3 then array_to_string(string_split(tgt, '.')[1:3], '.') else 'N/A' end as minor,
       array_to_string(list_transform(range(1, least(3, len(list_filter(string_split(base, '.'), lambda x: x <> ''))) + 1),
                                      lambda i: array_to_string(list_filter(string_split(base, '.'), lambda x: x <> '')[1:i], '.')), '/') as path
from k""",
)
def _(spark, sf):
    df = fixture(spark, sf, "req_rows")
    obj = (
        F.when(F.col("d") % 3 == 0, F.concat(F.lit("Sec "), F.coalesce("num", F.lit("")), F.lit(".7.9")))
        .when(F.col("d") % 3 == 1, F.concat(F.lit("v"), F.col("d").cast("string")))
        .otherwise(F.col("num"))
    )
    return df.select(
        "d",
        I.section_base("num").alias("section_base"),
        I.major_key(obj).alias("major"),
        I.minor_key(obj).alias("minor"),
        F.array_join(I.section_path("num"), "/").alias("path"),
    )


@check(
    "heading_block",
    f"""select doc_id, {sql_strip("regexp_extract(md, '(?ims)^##\\s+Part two\\s*$(.*?)(?:^\\s*##?\\s+|\\z)', 1)")} as block
from md_docs""",
)
def _(spark, sf):
    return fixture(spark, sf, "md_docs").select("doc_id", X.heading_block("md", "part two").alias("block"))


@check(
    "text_helpers",
    f"""select doc_id, {sql_strip("regexp_replace(text, '" + BC + "+', ' ', 'g')")} as one_line,
       case when length(text) <= 300 then text else rtrim(left(text, 300), '{BL}') || '...' end as cut,
       case when {sql_strip("source")} = '' then 'N/A' else {sql_strip("source")} end as src,
       lower({sql_strip("lang")}) in ('1', 'true', 't', 'yes', 'y') as truth, {sql_strip("text")} as clean
from documents""",
)
def _(spark, sf):
    return fixture(spark, sf, "documents").select(
        "doc_id",
        X.single_line("text").alias("one_line"),
        X.truncate_text("text", 300).alias("cut"),
        X.value_or_na("source").alias("src"),
        X.bool_from_value("lang").alias("truth"),
        X.clean_str("text").alias("clean"),
    )


@check(
    "formula_safe",
    """with v as (select o_orderkey, substr('=+-@ab', cast(o_orderkey % 6 + 1 as int), 1) || o_orderpriority as t from orders)
select o_orderkey, case when left(t, 1) in ('=', '+', '-', '@') then '''' || t else t end as safe from v""",
)
def _(spark, sf):
    t = F.concat(F.substring(F.lit("=+-@ab"), (F.col("o_orderkey") % 6 + 1).cast("int"), F.lit(1)), "o_orderpriority")
    return fixture(spark, sf, "orders").select("o_orderkey", X.formula_safe(t).alias("safe"))


@check(
    "fingerprint",
    """select doc_id, 'FINGERPRINT::' || case when doc_id % 2 = 0 then 'REQ-' || doc_id else sha1(path) || sha1(md) end as fp,
       sha256(md) as sha,
       substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
       substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) ||
       substr(h, 18, 3) || '-' || substr(h, 21, 12) as chunk_id
from (select *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(path || '::' || doc_id)) as h from md_docs)""",
)
def _(spark, sf):
    req = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("REQ-"), F.col("doc_id").cast("string")))
    return fixture(spark, sf, "md_docs").select(
        "doc_id",
        X.fingerprint("path", "md", req).alias("fp"),
        X.content_sha("md").alias("sha"),
        X.chunk_id("path", "doc_id").alias("chunk_id"),
    )


@check(
    "word_count",
    f"select doc_id, cast(len(list_filter(regexp_split_to_array(text, '{BC}+'), lambda x: x <> '')) as int) as words from documents",
)
def _(spark, sf):
    return fixture(spark, sf, "documents").select("doc_id", X.word_count("text").alias("words"))


@check(
    "label",
    """select d, coalesce(nullif(concat_ws(' | ', nullif(req, ''), nullif(num, ''), nullif(safety, '')), ''), cast(d as varchar)) as label
from req_rows""",
)
def _(spark, sf):
    return fixture(spark, sf, "req_rows").select("d", X.label("d", ["req", "num", "safety"]).alias("label"))


@check(
    "metadata_from_name",
    """select page_id, nullif(regexp_extract(url, '^https?://([^/]+)/?([^/?]*)', 1), '') as host,
       coalesce(nullif(regexp_extract(url, '^.*?([0-9]+)[^0-9]*$', 1), ''),
                nullif(regexp_extract(url, '^https?://([^/]+)/?([^/?]*)', 2), '')) as first_part
from pages""",
)
def _(spark, sf):
    found = X.metadata_from_name(
        "url", [r"https?://(?P<host>[^/]+)/?(?P<first_part>[^/?]*)", r".*?(?P<first_part>\d+)[^0-9]*$"]
    )
    return fixture(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in found.items()])


@check(
    "natural_key",
    """with k as (select distinct coalesce(Object_Number, '') as n from reqs),
p as (select n, coalesce(try_cast(nullif(regexp_extract(n, '^(\\d+)\\.(\\d+)(-(\\d+))?$', 1), '') as int), -1) as a,
             coalesce(try_cast(nullif(regexp_extract(n, '^(\\d+)\\.(\\d+)(-(\\d+))?$', 2), '') as int), -1) as b,
             coalesce(try_cast(nullif(regexp_extract(n, '^(\\d+)\\.(\\d+)(-(\\d+))?$', 4), '') as int), -1) as c from k)
select n, row_number() over (order by a, b, c) as pos from p""",
)
def _(spark, sf):
    from tracegrid.operators.ordered import row_number

    numbers = fixture(spark, sf, "reqs").select(F.coalesce("Object_Number", F.lit("")).alias("n")).distinct()
    keyed = numbers.withColumn("k", I.natural_key("n"))
    return row_number(keyed, ["k"], "pos").select("n", "pos")
