"""Following trace links between requirements."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import ids as I
from tracegrid.functions.text import clean_str, heading_block, text, truncate_text, value_or_na
from tracegrid.operators.ordered import union_all
from tracegrid.operators.storage import materialize


def req_index(reqs: DataFrame, order_by: Sequence[str], fields: Sequence[str], last: bool = False) -> DataFrame:
    """One row per non-blank id: the first (or last) requirement that carries it."""
    pick = F.max_by if last else F.min_by
    known = reqs.where(clean_str("Req_ID") != "").groupBy(clean_str("Req_ID").alias("Req_ID"))
    picked = known.agg(pick(F.struct(*fields), F.struct(*order_by)).alias("row"))
    return picked.select("Req_ID", *[F.col("row")[f].alias(f) for f in fields])


def req_index_lookup(ids: DataFrame, id_col: str, reqs: DataFrame, order_by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Each id with the fields of the first requirement that carries it, ``N/A`` where none does."""
    index = req_index(reqs, order_by, fields).withColumnRenamed("Req_ID", "__id")
    joined = ids.join(index, F.col(id_col) == F.col("__id"), "left")
    return joined.select(*ids.columns, *[value_or_na(index[f]).alias(f"linked_{f}") for f in fields])


def section_titles(reqs: DataFrame, order_by: Sequence[str], per_document: bool = False) -> DataFrame:
    """First title seen per section number; across documents unless ``per_document``."""
    number, title = resolve_number(reqs), own_title(reqs)
    keys = [number.alias("section"), *([F.col("Doc_Name")] if per_document else [])]
    titled = reqs.where((number != "") & (title != ""))
    return titled.groupBy(*keys).agg(F.min_by(title, F.struct(*order_by)).alias("title"))


def _first_present(reqs: DataFrame, names: Sequence[str]) -> Column:
    there = [F.nullif(clean_str(n), F.lit("")) for n in names if n in reqs.columns]
    return F.coalesce(*there, F.lit(""))


def resolve_number(reqs: DataFrame) -> Column:
    return _first_present(reqs, ("Section_Number", "SRS_Section", "Section"))


def own_title(reqs: DataFrame) -> Column:
    return _first_present(reqs, ("Section_Title", "SRS_Title", "SectionTitle"))


def with_section_title(reqs: DataFrame, order_by: Sequence[str], per_document: bool = False) -> DataFrame:
    """Add ``resolved_number`` and ``resolved_title``: the mapped title, else the row's own."""
    titles = section_titles(reqs, order_by, per_document).withColumnsRenamed({"section": "__section", "title": "__title"})
    keyed = reqs.withColumn("resolved_number", resolve_number(reqs)).withColumn("__own", own_title(reqs))
    on = [F.col("resolved_number") == F.col("__section")]
    if per_document:
        titles = titles.withColumnRenamed("Doc_Name", "__doc")
        on.append(F.col("Doc_Name") == F.col("__doc"))
    joined = keyed.join(titles, on, "left")
    return joined.select(*reqs.columns, "resolved_number", F.coalesce("__title", "__own").alias("resolved_title"))


def link_context(
    reqs: DataFrame,
    order_by: Sequence[str],
    in_links: Column,
    out_links: Column,
    max_links: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Per requirement the texts its links point at.

    Adds the id lists ``in_ids``, ``out_ids`` and ``inline_ids`` (where asked, the
    first ``max_links`` each), the lines ``linked_lines`` (an inline id that is
    already linked is not repeated) and ``referenced_lines``. ``reqs`` must
    carry ``resolved_title``. Texts are whole unless a ``limit`` in characters is
    given; they are cut before they are joined.
    """
    order = list(order_by)

    def first_links(ids: Column) -> Column:
        return ids if max_links is None else F.slice(ids, 1, max_links)

    lists = reqs.withColumns(
        {
            "in_ids": first_links(I.extract_link_ids(in_links)),
            "out_ids": first_links(I.extract_link_ids(out_links)),
            "inline_ids": first_links(I.extract_link_ids("Requirement_Text")),
        }
    )
    # Texts are searched and titles joined once; what follows reads them three times, by column. No file holds a column without type.
    typeless = [c for c, kind in lists.dtypes if kind == "void"]
    kept = materialize(lists.drop(*typeless), "zstd", free=True)
    lists = kept.withColumns({c: F.lit(None) for c in typeless}).select(*lists.columns) if typeless else kept

    def entries(side: int, tag: str, ids: str) -> Column:
        return F.transform(
            F.col(ids),
            lambda rid, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), F.lit(tag).alias("tag"), rid.alias("rid")),
        )

    linked = F.array_union(F.col("in_ids"), F.col("out_ids"))
    every = F.concat(entries(0, "in", "in_ids"), entries(1, "out", "out_ids"), entries(2, "text", "inline_ids"))
    # The outer form: the plain one would add a filter that searches every text twice.
    links = lists.select(*order, linked.alias("linked"), F.inline_outer(every)).where("rid is not null")
    shown = (F.col("side") < 2) | ~F.array_contains(F.col("linked"), F.col("rid"))
    links = links.select(*order, "side", "pos", "tag", "rid", shown.alias("shown"))
    shown_text = value_or_na("Requirement_Text")
    cut = lists.withColumn("Requirement_Text", shown_text if limit is None else truncate_text(shown_text, limit))
    index = req_index(cut, order, ["Requirement_Text", "Doc_Name", "resolved_title"]).withColumnRenamed("Req_ID", "__id")
    found = links.join(index, F.col("rid") == F.col("__id"), "left")
    where = F.concat(F.lit(" ("), value_or_na("Doc_Name"), F.lit(", "), value_or_na("resolved_title"), F.lit("): "))
    # A text goes once to the row that shows it; both kinds of lines are made of it there.
    entry = F.struct(
        F.struct("side", "pos").alias("at"),
        F.col("tag"),
        F.col("rid"),
        F.col("shown"),
        F.when(F.col("__id").isNotNull(), where).alias("where"),
        F.coalesce("Requirement_Text", F.lit("N/A")).alias("snippet"),
    )
    entries_of = found.groupBy(*order).agg(F.collect_list(entry).alias("__entries"))
    joined = lists.join(entries_of, order, "left")

    def listed(of: Callable[[Column], Column], line: Callable[[Column], Column]) -> Column:
        """The lines of these entries in their places."""
        placed = F.transform(F.filter("__entries", of), lambda x: F.struct(x["at"].alias("at"), line(x).alias("line")))
        return F.coalesce(F.transform(F.array_sort(placed), lambda x: x["line"]), F.array().cast("array<string>"))

    shown_lines = listed(
        lambda x: x["shown"],
        lambda x: F.concat(
            F.lit("- ["), x["tag"], F.lit("] "), x["rid"], F.coalesce(F.concat(x["where"], x["snippet"]), F.lit(": N/A"))
        ),
    )
    referenced = listed(
        lambda x: x["at"]["side"] == 2, lambda x: F.concat(F.lit("Referenced "), x["rid"], F.lit(": "), x["snippet"])
    )
    return joined.select(*lists.columns, shown_lines.alias("linked_lines"), referenced.alias("referenced_lines"))


# --- trace graph --------------------------------------------------------------


def _comma_ids(c: str) -> Column:
    return F.filter(F.transform(F.split(text(c), ","), clean_str), lambda t: t != "")


def resolved_links(reqs: DataFrame, key: str, side: str) -> DataFrame:
    """(page, rank, target, target_id): the links of each page that resolve, ranked in list order.

    Where an id repeats the last page carrying it is the target. The rank is
    over one page's own list, so the window is never larger than a cell.
    """
    index = req_index(reqs, [key], [key], last=True).select(
        F.col("Req_ID").alias("target_id"), F.col(key).alias("target")
    )
    listed = reqs.select(F.col(key).alias("page"), F.posexplode(_comma_ids(side)).alias("pos", "target_id"))
    joined = listed.join(index, "target_id")
    rank = F.row_number().over(Window.partitionBy("page").orderBy("pos"))
    return joined.select("page", rank.alias("rank"), "target", "target_id")


def trace_neighbourhood(
    reqs: DataFrame,
    key: str,
    depth: int = 1,
    max_parents: int | None = None,
    max_children: int | None = None,
    max_grandparents: int | None = None,
    max_grandchildren: int | None = None,
    core: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around the core requirements, up to two hops.

    All related pages, or as many of each kind as the caller asks for.

    A related page is one node per core (or per parent for the second hop), so
    node ids are made of the page and its role. The links and the steps taken
    are kept, as nodes and edges are both read from them.
    """
    cores = reqs.where(core) if core is not None else reqs
    pages = cores.select(F.col(key).alias("core"))
    hops: list[DataFrame] = []

    def within(cap: int | None) -> Column:
        return F.lit(True) if cap is None else F.col("rank") <= cap

    sides = (("Parent_Req_IDs", max_parents, max_grandparents), ("Child_Req_IDs", max_children, max_grandchildren))
    for side, (column, cap, far_cap) in enumerate(sides):
        if depth < 1:
            break
        links = materialize(resolved_links(reqs, key, column))
        first = links.where(within(cap)).join(pages, F.col("page") == F.col("core"))
        first = first.select(F.lit(side).alias("side"), "core", F.col("target").alias("near"))
        hops.append(first.withColumn("far", F.lit(None).cast(reqs.schema[key].dataType)))
        if depth >= 2:
            second = links.where(within(far_cap)).select(F.col("page").alias("near"), F.col("target").alias("far"))
            hops.append(first.join(second, "near").select("side", "core", "near", "far"))

    def node(page: str, role: Column, around: str | None = None) -> Column:
        tail = [F.lit("|"), role] + ([F.lit(":"), F.col(around).cast("string")] if around else [])
        return F.concat(F.col(page).cast("string"), *tail)

    core_id = node("core", F.lit("core"))
    nodes = pages.select(core_id.alias("node_id"), F.col("core").alias("page"), F.lit("core").alias("role")).distinct()
    if not hops:
        return nodes, pages.select(core_id.alias("source"), core_id.alias("target")).where(F.lit(False))

    steps = materialize(union_all(hops))
    outward = F.col("side") == 1
    near_role = F.when(outward, "child").otherwise("parent")
    far_role = F.when(outward, "grandchild").otherwise("grandparent")
    near_id, far_id = node("near", near_role, "core"), node("far", far_role, "near")
    one_hop = F.col("far").isNull()
    around = steps.select(
        F.when(one_hop, near_id).otherwise(far_id).alias("node_id"),
        F.coalesce("far", "near").alias("page"),
        F.when(one_hop, near_role).otherwise(far_role).alias("role"),
    ).distinct()
    inner = F.when(one_hop, core_id).otherwise(near_id)
    outer = F.when(one_hop, near_id).otherwise(far_id)
    edges = steps.select(
        F.when(outward, inner).otherwise(outer).alias("source"), F.when(outward, outer).otherwise(inner).alias("target")
    ).distinct()
    return nodes.unionByName(around), edges


def related_with_block(
    reqs: DataFrame, key: str, body_col: str, heading: str, scope: str = "self", cap: int = 6
) -> DataFrame:
    """Per core the related pages whose body has a filled heading block.

    Core first, then parents, then children, each page once. The first ``cap``
    are marked as shown, the others stay in the result as overflow.
    """
    takes = {"self": (0,), "parents": (1,), "children": (2,), "both": (0, 1, 2)}
    if scope not in takes:
        raise ValueError(f"unknown scope: {scope}")
    frames = []
    if 0 in takes[scope]:
        frames.append(reqs.select(F.col(key).alias("core"), F.col(key).alias("page"), F.lit(0).alias("side"), F.lit(0).alias("rank")))
    for side, column in ((1, "Parent_Req_IDs"), (2, "Child_Req_IDs")):
        if side in takes[scope]:
            links = resolved_links(reqs, key, column)
            frames.append(links.select(F.col("page").alias("core"), F.col("target").alias("page"), F.lit(side).alias("side"), "rank"))
    candidates = frames[0]
    for f in frames[1:]:
        candidates = candidates.unionByName(f)
    once = candidates.groupBy("core", "page").agg(F.min(F.struct("side", "rank")).alias("at"))
    holding = reqs.where(heading_block(body_col, heading, "h1_h2") != "").select(F.col(key).alias("page"), "Req_ID")
    kept = once.join(holding, "page")
    position = F.row_number().over(Window.partitionBy("core").orderBy("at"))
    return kept.select("core", "page", "Req_ID", position.alias("position")).withColumn(
        "shown", F.col("position") <= cap
    )


def parent_tags(reqs: DataFrame, key: str, tags_col: str = "tags") -> DataFrame:
    """Distinct tags of a requirement's parents, in order of first appearance."""
    links = resolved_links(reqs, key, "Parent_Req_IDs")
    tagged = reqs.select(F.col(key).alias("target"), F.posexplode(tags_col).alias("tag_pos", "tag"))
    firsts = links.join(tagged, "target").groupBy("page", "tag").agg(F.min(F.struct("rank", "tag_pos")).alias("at"))
    lists = firsts.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("at", "tag"))).alias("t"))
    return lists.select(F.col("page").alias(key), F.transform("t", lambda x: x["tag"]).alias("parent_tags"))
