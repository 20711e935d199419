"""Filtering, grouping, sorting and summarising requirements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import ids as I
from tracegrid.functions.text import BLANK_CLASS, clean_str, named, py_strip, text
from tracegrid.operators import ordered
from tracegrid.operators.storage import materialize
from tracegrid.operators.trace import resolve_number

HEADER, ROW = "Header", "Requirement"
LIST_PART = 1000


# --- filters -------------------------------------------------------------------


def wildcard_match(c, pattern: str | None) -> Column:
    """``*`` matches anything; other characters keep their regex meaning; not anchored."""
    if not pattern:
        return F.lit(True)
    return F.rlike(text(c), F.lit("(?iu)" + pattern.replace("*", ".*")))


def wildcard_filter(df: DataFrame, cols: Sequence[str], pattern: str | None) -> DataFrame:
    if not pattern:
        return df
    hit = F.lit(False)
    for c in cols:
        hit = hit | wildcard_match(c, pattern)
    return df.where(hit)


def viewer_filter(
    reqs: DataFrame,
    doc_type: str | None = None,
    doc_name: str | None = None,
    req_types: Sequence[str] = (),
    level: str | None = None,
    section: str | None = None,
    section_title: str | None = None,
    req_id: str | None = None,
    headers_only: bool = False,
    global_text: str | None = None,
    body_col: str = "body",
) -> DataFrame:
    """All given conditions at once; ``section`` matches the number or the title."""
    out = reqs
    for column, value in (("Doc_Type", doc_type), ("Doc_Name", doc_name), ("Level", level)):
        if value:
            out = out.where(F.col(column) == value)
    if req_types:
        out = out.where(F.coalesce("Requirement_Type", "Section_Type").isin(*req_types))
    if section:
        out = out.where(wildcard_match(section_cell(reqs), section) | wildcard_match("Section_Title", section))
    if section_title:
        out = out.where(wildcard_match("Section_Title", section_title))
    if req_id:
        out = out.where(wildcard_match("Req_ID", req_id))
    if headers_only:
        out = out.where("Is_Section_Header")
    if global_text:
        out = out.where(wildcard_match(body_col, global_text))
    return out


def section_cell(reqs: DataFrame) -> Column:
    """The section a rendered requirement shows: its object number, else its section number."""
    if "Section" in reqs.columns:
        return text("Section")
    return F.coalesce(F.nullif(clean_str("Object_Number"), F.lit("")), resolve_number(reqs))


# --- sorting and grouping --------------------------------------------------------


def normalize_title(c) -> Column:
    return py_strip(F.regexp_replace(text(c), BLANK_CLASS + "+", " "))


def leading_number(c) -> Column:
    """The dotted number a title starts with, else the empty string."""
    return F.regexp_extract(normalize_title(c), r"^(\d+(?:\.\d+)*)\b", 1)


def section_order(c) -> Column:
    """Orderable form of a section id: blank last, else numbers part by part.

    Missing parts count as zero, so trailing zeros are cut and ``1``, ``1.0``
    compare equal. A part that does not start with digits counts as zero.
    """
    key = clean_str(c)
    parts = F.transform(
        F.split(key, r"\."),
        lambda p: I.digits_key(F.regexp_extract(p, r"^\s*(\d+)", 1)),
    )
    length = F.array_max(F.transform(parts, lambda p, i: F.when(p["length"] != 0, i + 1).otherwise(F.lit(0))))
    none = F.array().cast("array<struct<length:int,digits:string>>")
    return F.struct((key == "").alias("blank"), F.when(key == "", none).otherwise(F.slice(parts, 1, length)).alias("parts"))


def page_sort_key(reqs: DataFrame) -> Column:
    """Section, else object number, else local number, else the title's number, else the id."""
    names = [c for c in ("Section", "Object_Number", "SRS_Local_Req_No") if c in reqs.columns]
    cells = [F.nullif(clean_str(c), F.lit("")) for c in names]
    key = F.coalesce(*cells, F.nullif(leading_number("Section_Title"), F.lit("")), text("Req_ID"))
    lead = leading_number(key)
    return section_order(F.when(lead != "", lead).otherwise(key))


def section_sort(reqs: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Sorted by dotted section number, then id, then ``order_by``."""
    return reqs.orderBy(page_sort_key(reqs), text("Req_ID"), *order_by)


def section_groups(reqs: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The reading queue: each group's heading row, then its requirements, with positions."""
    title = normalize_title("Section_Title")
    keyed = reqs.select(
        F.when(title == "", F.lit("Unsectioned")).otherwise(title).alias("group_title"),
        F.lit("page").alias("entry"),
        F.lit(1).alias("__kind"),
        page_sort_key(reqs).alias("__page"),
        text("Req_ID").alias("Req_ID"),
        F.struct(*order_by).alias("__tie"),
    )
    empty = {c: F.lit(None).cast(keyed.schema[c].dataType) for c in ("__page", "__tie")}
    heads = keyed.select("group_title").distinct().select(
        "group_title",
        F.lit("group").alias("entry"),
        F.lit(0).alias("__kind"),
        empty["__page"].alias("__page"),
        F.lit("").alias("Req_ID"),
        empty["__tie"].alias("__tie"),
    )
    queue = keyed.unionByName(heads).withColumn("__group", section_order(leading_number("group_title")))
    order = ["__group", "group_title", "__kind", "__page", "Req_ID", "__tie"]
    return ordered.row_number(queue, order, "queue_position").select("queue_position", "entry", "group_title", "Req_ID")


def page(df: DataFrame, order_by: Sequence[str], n: int = 50, number: int = 1) -> tuple[DataFrame, int]:
    """Rows of one page and the page count; the page number is clamped."""
    pages = max(1, -(-df.count() // n))
    start = (min(max(1, number), pages) - 1) * n
    placed = ordered.row_number(df, order_by, "__pos")
    return placed.where(F.col("__pos").between(start + 1, start + n)).drop("__pos").orderBy(*order_by), pages


def section_outline(reqs: DataFrame, doc_type: str, order_by: Sequence[str]) -> DataFrame:
    """Indented outline lines of one document type, numbered in reading order."""
    number = text("Object_Number")
    top = F.split_part(number, F.lit("."), F.lit(1))
    top = F.when(top == "", F.split_part(number, F.lit("-"), F.lit(1))).otherwise(top)
    lines = reqs.where((F.col("Doc_Type") == doc_type) & (number != "")).select(
        top.alias("section"),
        F.coalesce(top.try_cast("double"), F.lit(float("inf"))).alias("__top"),
        number.alias("Object_Number"),
        F.struct(*order_by).alias("__tie"),
        ((F.size(F.split(number, r"\.")) - 1) * 2).alias("indent"),
        "Req_ID",
        text("Section_Title").alias("Section_Title"),
        F.coalesce("Is_Section_Header", F.lit(False)).alias("Is_Section_Header"),
    )
    placed = ordered.row_number(lines, ["__top", "section", "Object_Number", "__tie"], "position")
    return placed.select("position", "section", "indent", "Object_Number", "Req_ID", "Section_Title", "Is_Section_Header")


# --- neighbours, names, buckets ---------------------------------------------------


def anchor(reqs: DataFrame) -> dict[str, Column]:
    """Document, type and base section of a row; the base is empty where it has no section."""
    return {
        "anchor_doc": clean_str("Doc_Name"),
        "anchor_type": clean_str("Doc_Type"),
        "anchor_base": I.section_base(resolve_number(reqs)),
    }


def row_sort_key(reqs: DataFrame) -> Column:
    """Natural order of the object number, else of the id; rows with neither come first."""
    number = clean_str("Object_Number") if "Object_Number" in reqs.columns else F.lit("")
    candidate = F.coalesce(F.nullif(number, F.lit("")), clean_str("Req_ID"))
    return F.struct(I.natural_key(candidate).alias("natural"), F.lower(candidate).alias("word"))


ANCHOR = ["anchor_doc", "anchor_type", "anchor_base"]


def section_member(reqs: DataFrame) -> Column:
    """Is the row one of its section: no header, with a section, an id and a text."""
    header = F.coalesce(F.col("Is_Section_Header"), F.lit(False))
    placed = anchor(reqs)["anchor_base"] != ""
    return placed & ~header & (clean_str("Req_ID") != "") & (clean_str("Requirement_Text") != "")


def neighbour_value() -> Column:
    return F.struct(clean_str("Req_ID").alias("id"), normalize_title("Requirement_Text").alias("text"))


def section_neighbours(reqs: DataFrame, order_by: Sequence[str], k_prev: int = 2, k_next: int = 2) -> DataFrame:
    """Add ``prev`` and ``next``: ids and one-line texts of the rows around in the same section.

    Headers and rows without id or text are no members and get empty lists.
    """
    keyed = reqs.withColumns({**anchor(reqs), "__sort": row_sort_key(reqs)})
    member = section_member(reqs)
    inside = ordered.neighbours(keyed.where(member), ANCHOR, ["__sort", *order_by], neighbour_value(), k_prev, k_next)
    empty = F.array().cast(inside.schema["prev"].dataType)
    outside = keyed.where(~member).withColumn("prev", empty).withColumn("next", empty)
    return inside.unionByName(outside).drop("__sort")


def unique_names(
    df: DataFrame, scope: Sequence[str], stem: Column, order_by: Sequence[str], out: str = "unique_name", max_length: int = 100
) -> DataFrame:
    """Names unique within a scope: the first row keeps its stem, others get ``-1``, ``-2``, ...

    A stem that is itself of the form ``name-3`` is never taken by a generated
    name: the j-th repeat of ``name`` gets the j-th number not held by such a
    stem, found by one running count over repeats and held numbers together.
    Names are worked out on the stems alone and joined back by ``order_by``.
    """
    keys, order = [*scope, "__stem"], list(order_by)
    stemmed = materialize(df.select(*scope, *order, F.substring(stem, 1, max_length).alias("__stem")))
    numbered = ordered.row_number(stemmed, order_by, "__nth", keys)
    first = F.col("__nth") == 1

    stems = stemmed.groupBy(*keys).agg(F.count("*").alias("__n"))
    shape = r"(?s)^(.*)-([1-9][0-9]{0,17})\z"
    held = stems.select(
        *scope,
        F.regexp_extract("__stem", shape, 1).alias("__base"),
        F.regexp_extract("__stem", shape, 2).try_cast("long").alias("__k"),
    ).where(F.col("__k").isNotNull())
    repeated = stems.where(F.col("__n") > 1).select(*scope, F.col("__stem").alias("__base"))
    held = held.join(repeated, [*scope, "__base"], "left_semi").withColumnRenamed("__base", "__stem")
    ranked = ordered.row_number(held, ["__k"], "__i", keys)
    marks = ranked.select(*keys, (F.col("__k") - F.col("__i")).alias("__at"), F.lit(1).alias("__mark"), F.col("__i").alias("__sub"))
    repeats = numbered.where(~first).withColumn("__j", F.col("__nth") - 1)
    tagged = repeats.select(
        "*", F.col("__j").alias("__at"), F.lit(0).alias("__mark"), F.lit(0).cast("long").alias("__sub")
    ).unionByName(marks, allowMissingColumns=True)
    counted = ordered.ordered_scan(
        tagged, ["__at", "__mark", "__sub"], keys, sums={"__held": F.col("__mark").cast("long")}
    ).where(F.col("__mark") == 0)
    named = counted.withColumn(
        out, F.concat("__stem", F.lit("-"), (F.col("__j") + F.col("__held")).cast("string"))
    )
    names = numbered.where(first).select(*order, F.col("__stem").alias(out)).unionByName(named.select(*order, out))
    return df.join(names, order).select(*df.columns, out)


def bucket_blocks(
    reqs: DataFrame, order_by: Sequence[str], scope: Sequence[str] = ("Doc_Name",), max_per: int = 250
) -> DataFrame:
    """Add ``bucket``: the major section; the minor one where a major is too large; else numbered parts."""
    order = list(order_by)
    numbers = reqs.select(
        *scope, *order, I.major_key("Object_Number").alias("__major"), I.minor_key("Object_Number").alias("__minor")
    )
    finer = F.when(F.col("__minor") != "N/A", F.col("__minor")).otherwise(F.col("__major"))
    # Buckets are worked out on the numbers alone and joined back by the order.
    keyed = materialize(numbers.withColumn("__finer", finer))
    minors = keyed.groupBy(*scope, "__major", "__finer").agg(F.count("*").alias("__in_minor"))
    majors = minors.groupBy(*scope, "__major").agg(F.sum("__in_minor").alias("__in_major"))
    large = minors.join(majors, [*scope, "__major"]).where(F.col("__in_major") > max_per)
    sized = keyed.join(large, [*scope, "__major", "__finer"], "left")
    placed = ordered.row_number(sized, order_by, "__nth", [*scope, "__major", "__finer"])
    part = (F.floor((F.col("__nth") - 1) / max_per) + 1).cast("string")
    part = F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)
    bucket = (
        F.when(F.col("__in_major").isNull(), F.col("__major"))
        .when(F.col("__in_minor") <= max_per, F.col("__finer"))
        .otherwise(F.concat("__finer", F.lit("__part"), part))
    )
    return reqs.join(placed.select(*order, bucket.alias("bucket")), order).select(*reqs.columns, "bucket")


# --- summaries ---------------------------------------------------------------------


def _titled(reqs: DataFrame) -> DataFrame:
    return reqs.where(text("Section_Title") != "")


def doc_type_summary(reqs: DataFrame) -> DataFrame:
    return reqs.groupBy("Doc_Type").agg(
        F.count("*").alias("total"), F.count(F.nullif(F.col("Section_Title"), F.lit(""))).alias("with_section")
    )


def section_coverage(reqs: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` sections with most requirements; ties by title and type."""
    counted = _titled(reqs).groupBy("Section_Title", "Doc_Type").agg(F.count("*").alias("requirements"))
    return counted.orderBy(F.desc("requirements"), "Section_Title", "Doc_Type").limit(n)


def section_stats(reqs: DataFrame) -> DataFrame:
    header = F.coalesce(F.col("Is_Section_Header"), F.lit(False))
    name = F.concat(text("Doc_Type"), F.lit(" - "), "Section_Title").alias("section")
    stats = _titled(reqs).groupBy(name).agg(
        F.count_if(header).alias("headers"), F.count_if(~header).alias("requirements"), F.count("*").alias("total")
    )
    return stats.orderBy(F.desc("total"), "section")


def section_rollup(reqs: DataFrame, doc_type: str, order_by: Sequence[str], list_part: int = LIST_PART) -> DataFrame:
    """Count and requirement list per title and object number.

    The list of a very large group comes in numbered parts of ``list_part`` ids.
    """
    chosen = _titled(reqs).where(F.col("Doc_Type") == doc_type)
    group = ["Section_Title", "Object_Number"]
    rows = chosen.select(*group, text("Req_ID").alias("Req_ID"), F.struct(*order_by).alias("__tie"))
    parts = ordered.parts_of_group(rows, group, ["Req_ID", "__tie"], list_part)
    lists = parts.groupBy(*group, "part").agg(
        F.array_sort(F.collect_list(F.struct("Req_ID", "__tie"))).alias("r"), F.count("*").alias("requirements_in_part")
    )
    # One row per part here, so the window over a group is short.
    total = F.sum("requirements_in_part").over(Window.partitionBy(*group))
    return lists.select(
        *group, "part", "requirements_in_part", total.alias("total"), F.transform("r", lambda x: x["Req_ID"]).alias("requirements")
    )


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sorted distinct non-blank values of each column, in one pass over the rows."""
    cells = [F.struct(F.lit(c).alias("column_name"), named(c).cast("string").alias("value")) for c in cols]
    listed = df.select(F.inline(F.array(*cells))).where(F.col("value") != "")
    return listed.distinct().orderBy("column_name", "value")


# --- saved queries -------------------------------------------------------------------


def _label(is_header: Column) -> Column:
    return F.when(F.coalesce(is_header, F.lit(False)), HEADER).otherwise(ROW)


def all_requirements(reqs: DataFrame) -> DataFrame:
    return reqs.select(
        "Req_ID", "Doc_Type", "Section_Title", "Object_Number", _label(F.col("Is_Section_Header")).alias("label"), "Level"
    ).orderBy("Section_Title", "Object_Number", "Req_ID")


def by_doc_type(reqs: DataFrame, doc_types: Sequence[str]) -> DataFrame:
    """Requirements of the given types; an alias type is passed along with the type it stands for."""
    return reqs.where(F.col("Doc_Type").isin(*doc_types)).select(
        "Req_ID", "Doc_Type", "Section_Title", "Object_Number", _label(F.col("Is_Section_Header")).alias("label")
    ).orderBy("Doc_Type", "Section_Title", "Object_Number", "Req_ID")


def by_level(reqs: DataFrame, terms: Sequence[str]) -> DataFrame:
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(text("Level"), F.lit(t))
    return reqs.where(hit).select("Req_ID", "Doc_Type", "Level", "Section_Title").orderBy("Level", "Req_ID")


def section_headers(reqs: DataFrame, inferred: bool | None = None) -> DataFrame:
    """Section headers; ``inferred=False`` leaves out those whose section was inferred."""
    out = reqs.where("Is_Section_Header")
    if inferred is not None:
        out = out.where(F.coalesce("Section_Inferred", F.lit(False)) == inferred)
    return out.select("Req_ID", "Doc_Type", "Section_Title", "Object_Number").orderBy("Doc_Type", "Object_Number", "Req_ID")


def by_links(reqs: DataFrame, parents: bool | None = None, children: bool | None = None) -> DataFrame:
    """Requirements that have (True) or lack (False) parents and children."""
    out = reqs
    for column, wanted in (("Parent_Req_IDs", parents), ("Child_Req_IDs", children)):
        if wanted is not None:
            out = out.where((text(column) != "") == wanted)
    return out.select("Req_ID", "Doc_Type", "Section_Title", "Parent_Req_IDs", "Child_Req_IDs").orderBy("Doc_Type", "Req_ID")


def by_section_term(reqs: DataFrame, term: str) -> DataFrame:
    return reqs.where(F.contains(text("Section_Title"), F.lit(term))).select(
        "Req_ID", "Section_Title", "Object_Number", _label(F.col("Is_Section_Header")).alias("label"), "Parent_Req_IDs"
    ).orderBy("Object_Number", "Req_ID")


def browse_by_section(reqs: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Titled requirements grouped by title, with their place in the whole list."""
    rows = _titled(reqs).select(
        "Section_Title",
        text("Object_Number").alias("__number"),
        F.struct(*order_by).alias("__tie"),
        "Req_ID",
        F.coalesce(F.nullif(F.col("Object_Number"), F.lit("")), F.lit("—")).alias("Object_Number"),
        _label(F.col("Is_Section_Header")).alias("label"),
    )
    placed = ordered.row_number(rows, ["Section_Title", "__number", "__tie"], "position")
    return placed.select("position", "Section_Title", "Req_ID", "Object_Number", "label")


# --- bulk changes ------------------------------------------------------------------------


def _tag_list(df: DataFrame, tags_col: str) -> Column:
    kind = df.schema[tags_col].dataType.typeName()
    none = F.array().cast("array<string>")
    if kind == "array":
        return F.coalesce(F.col(tags_col), none)
    return F.when(text(tags_col) == "", none).otherwise(F.array(F.col(tags_col).cast("string")))


def bulk_tag(df: DataFrame, predicate: Column, tag: str, tags_col: str = "tags") -> tuple[DataFrame, DataFrame]:
    """Add a tag where it is missing, and the number of rows changed."""
    tags = _tag_list(df, tags_col)
    changes = F.coalesce(predicate, F.lit(False)) & ~F.array_contains(tags, F.lit(tag))
    tagged = df.withColumn(tags_col, F.when(changes, F.array_append(tags, F.lit(tag))).otherwise(tags))
    return tagged, df.agg(F.count_if(changes).alias("updated"))


def bulk_note(df: DataFrame, predicate: Column, note: str, notes_col: str = "notes") -> tuple[DataFrame, DataFrame]:
    """Overwrite the note on matching rows, and the number of rows changed."""
    hit = F.coalesce(predicate, F.lit(False))
    old = F.col(notes_col) if notes_col in df.columns else F.lit(None).cast("string")
    return df.withColumn(notes_col, F.when(hit, F.lit(note)).otherwise(old)), df.agg(F.count_if(hit).alias("updated"))
