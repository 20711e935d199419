"""Documents to a chunk store, and questions to contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from tracegrid.operators.chunks import chunk_documents
from tracegrid.operators.ingest import incremental_ingest, metadata_only_update, stored_chunks
from tracegrid.operators.retrieval import build_context, rerank, retrieve_all


def rag_ingest(
    docs: DataFrame, manifest: DataFrame, store: DataFrame | None = None, metadata_only: bool = False, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New store, new manifest and (path, status).

    With ``metadata_only`` no text is stored anew: the chunks of documents whose
    content is as stored take the metadata worked out now; the status is the
    verdict per document, and the manifest stays as it is.
    """
    if not metadata_only:
        return incremental_ingest(docs, manifest, store, **options)
    chunks = chunk_documents(docs, "source_path", "text", **options)
    updates, verdicts = metadata_only_update(chunks, manifest)
    fresh = stored_chunks(updates)
    if store is not None:
        fresh = store.join(fresh.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True)
    return fresh, manifest, verdicts.withColumnRenamed("verdict", "status")


def rag_query(
    corpus: DataFrame,
    queries: DataFrame,
    filters: dict[str, str] | None = None,
    top_n: int = 80,
    top_k: int = 10,
    scorer: Callable[[Column, Column], Column] | None = None,
    text_col: str = "text",
    query_text: str = "query_text",
    **columns: str,
) -> DataFrame:
    """One context text per query: nearest chunks, filtered, reranked and cut to ``top_k``."""
    found = retrieve_all(corpus, queries, filters, top_n, **columns)
    if scorer is not None:
        asked = queries.select(columns.get("query_id", "query_id"), query_text)
        found = found.join(asked.toDF("query_id", query_text), "query_id")
    return build_context(rerank(found, scorer, top_k, query_text, text_col), text_col)
