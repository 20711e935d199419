"""From requirement sheets to every table and text made of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators import render
from tracegrid.operators import requirements as r
from tracegrid.operators.ordered import row_number, union_all
from tracegrid.operators.storage import empty_frame, materialize


@dataclass(frozen=True)
class Sheet:
    """One input document."""

    rows: DataFrame
    kind: r.DocKind
    name: str
    level: str
    order_by: Sequence[str]
    skip_object_types: Sequence[str] = ()

    @property
    def document(self) -> r.Document:
        return r.Document(self.name, self.kind.doc_type, self.level)


# Where a normaliser's scan numbers its accepted rows on the way; for one that does not, they are numbered after.
PLACE = "__place_in_sheet"

Normalizer = Callable[[Sheet], tuple[DataFrame, DataFrame | None, DataFrame | None]]


def _traceable(dedupe: bool) -> Normalizer:
    def run(s: Sheet):
        sheet_columns = [c for c in s.rows.columns if c not in s.order_by]
        accepted, rejected = r.normalize_traceable(
            s.rows, s.kind, s.document, s.order_by, (), sheet_columns, dedupe_links=dedupe, place=PLACE
        )
        return accepted, rejected, None

    return run


def _merged(s: Sheet):
    accepted, collapsed = r.normalize_merged(s.rows, s.kind, s.document, s.order_by)
    return accepted, None, collapsed


def _guideline(s: Sheet):
    accepted, rejected = r.normalize_guideline(
        s.rows, s.kind, s.document, s.order_by, (), s.skip_object_types, place=PLACE
    )
    return accepted, rejected, None


# Which normaliser reads which kind of sheet; callers may add their own.
NORMALIZERS: dict[str, Normalizer] = {
    "fcss": _traceable(dedupe=False),
    "css": _traceable(dedupe=False),
    "fsrd": _traceable(dedupe=True),
    "fcsrd": _traceable(dedupe=True),
    "csrd": _traceable(dedupe=True),
    "scd": _traceable(dedupe=True),
    "generic": _traceable(dedupe=True),
    "srs": _merged,
    "ssg": _guideline,
}


@dataclass(frozen=True)
class Requirements:
    """All requirements in input order (``row_idx``), and what was left out."""

    rows: DataFrame
    rejections: DataFrame
    missing: DataFrame
    summary: DataFrame

    def star(self) -> dict[str, DataFrame]:
        return r.build_star(self.rows, ["row_idx"])

    def markdown(self, **options) -> DataFrame:
        return render.requirement_markdown(self.rows, ["row_idx"], **options)

    def sections(self, **options) -> DataFrame:
        return render.section_documents(self.rows, ["row_idx"], **options)

    def neighbours(self, **options) -> DataFrame:
        return render.neighbour_markdown(self.rows, ["row_idx"], **options)

    def texts(self) -> DataFrame:
        return render.rag_text(self.rows, ["row_idx"])

    def blocks(self, **options) -> DataFrame:
        return render.rag_blocks(self.rows, ["row_idx"], **options)

    def merged(self, max_per: int = 250, **options) -> DataFrame:
        """The blocks of each section in files of at most ``max_per``."""
        return render.merged_sections(self.blocks(**options), ["row_idx"], max_per)

    def block_sizes(self, **options) -> DataFrame:
        """Sizes of the blocks of each document."""
        return render.block_size_stats(self.blocks(**options))


def normalizer_of(kind: r.DocKind, registry: dict[str, Normalizer]) -> Normalizer:
    for name in (kind.normalizer, kind.doc_type.lower()):
        if name in registry:
            return registry[name]
    raise ValueError(f"no normalizer for {kind.normalizer!r} or {kind.doc_type!r}")


def build_requirements(
    sheets: Sequence[Sheet], version: str = "", registry: dict[str, Normalizer] = NORMALIZERS
) -> Requirements:
    """Normalise each complete sheet and stack the results; incomplete ones are reported."""
    missing = r.validate_columns([(s.name, s.rows, s.kind) for s in sheets])
    accepted, rejected, collapsed, totals, before = [], [], [], [], 0
    for s in sheets:
        if r.missing_columns(s.rows, s.kind):
            continue
        rows, bad, merged = normalizer_of(s.kind, registry)(s)
        if PLACE not in rows.columns:
            rows = row_number(rows, ["Row_Index"], PLACE)
        # One number per sheet comes to the driver, none of its rows.
        accepted.append(rows.withColumn("row_idx", F.col(PLACE) - 1 + F.lit(before).cast("long")).drop(PLACE))
        before += rows.count()
        totals.append(s.rows.agg(F.count("*").alias("total_rows")).select(
            F.lit(s.name).alias("Doc_Name"), F.lit(s.kind.doc_type).alias("Doc_Type"), "total_rows"
        ))
        rejected += [bad] if bad is not None else []
        collapsed += [merged] if merged is not None else []
    if not accepted:
        raise ValueError("no sheet has all of its required columns")
    stacked = r.flag_header_types(union_all(accepted)).withColumn("Schema_Version", F.lit(version))
    rows = materialize(stacked, "zstd")
    none = empty_frame(
        rows.sparkSession,
        "Doc_Name string, Doc_Type string, Level string, Reason string, Raw_Requirement_ID string, "
        "Object_Number string, Section_Number string, Row_Index bigint",
    )
    rejections = union_all(rejected) if rejected else none
    summary = r.normalization_summary(
        union_all(totals), rows, rejections, union_all(collapsed) if collapsed else None
    )
    return Requirements(rows, rejections, missing, summary)
