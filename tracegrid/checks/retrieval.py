"""Nearest vectors and what is made of them.

There is one query per label: the label's first vector.
"""

import pandas as pd
from pyspark.sql import functions as F

from tracegrid.checks import check
from tracegrid.fixtures import fixture
from tracegrid.operators import retrieval as r
from tracegrid.plans.retrieval import rag_query


def corpus(spark, sf):
    number, label = F.col("vec_id").cast("string"), F.col("label").cast("string")
    return fixture(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        "embedding",
        label.alias("doc_level"),
        F.concat(F.lit("Doc "), label).alias("doc_name"),
        F.concat(label, F.lit("."), (F.col("vec_id") % 5).cast("string")).alias("section_id"),
        F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("t"), (F.col("vec_id") % 2).cast("string"))).alias("tags"),
        F.concat(F.lit("/v/"), number).alias("source_path"),
        F.concat(number, F.lit(".md")).alias("file_name"),
        F.concat(F.lit(" Vector "), number, F.lit(" of "), label).alias("text"),
    )


def queries(spark, sf):
    firsts = fixture(spark, sf, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    name = F.concat(F.lit("label number "), F.col("label").cast("string"))
    return firsts.select(F.col("label").alias("query_id"), "embedding", name.alias("query_text"))


NEAR = """
corpus as (
  select vec_id as id, cast(embedding as double[]) as v, cast(label as varchar) as doc_level, 'Doc ' || label as doc_name, label || '.' || (vec_id % 5) as section_id,
         case when vec_id % 3 <> 0 then 't' || (vec_id % 2) end as tags, '/v/' || vec_id as source_path, vec_id || '.md' as file_name,
         'Vector ' || vec_id || ' of ' || label as text from embeddings),
queries as (select label as query_id, cast(min_by(embedding, vec_id) as double[]) as q, 'label number ' || label as query_text from embeddings group by label),
pairs as (
  select query_id, query_text, c.* exclude (v),
         round(1 - case when list_dot_product(v, v) * list_dot_product(q, q) = 0 then 0
               else list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q)) end, 12) as distance
  from corpus c, queries)
"""


def near(where: str, n: int) -> str:
    return f"""{NEAR},
ranked as (select *, row_number() over (partition by query_id order by distance, id) as rank from pairs where {where}),
kept as (select * from ranked where rank <= {n})"""


@check("vector_top_k", f"with {near('true', 80)} select query_id, id, round(distance, 6) + 0 as distance, rank from kept")
def _(spark, sf):
    found = r.vector_top_k(corpus(spark, sf), queries(spark, sf), 80)
    return found.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


FILTERS = {"tags": "t1", "section_prefix": "1"}
STORE = "contains(tags, 't1') and contains(section_id, '1')"


@check(
    "retrieve",
    f"""with {near(STORE, 60)},
local as (select *, row_number() over (partition by query_id order by rank) as position from kept where starts_with(section_id, '1'))
select query_id, id, rank, position, section_id from local where position <= 10""",
)
def _(spark, sf):
    found = r.retrieve(corpus(spark, sf), queries(spark, sf), FILTERS, top_n=60, top_k=10)
    return found.select("query_id", "id", "rank", "position", "section_id")


@check(
    "local_filter",
    """select vec_id as id from embeddings where (vec_id % 3 = 0 or vec_id % 2 = 1) and starts_with(label || '.' || (vec_id % 5), '3.')
and starts_with('/v/' || vec_id, '/v/1') and label = 3""",
)
def _(spark, sf):
    kept = r.local_filter(corpus(spark, sf), doc_level="3", tags="t1", section_prefix="3.", source_prefix="/v/1")
    return kept.select("id")


def length_score(query, body):
    """A stand-in for a model: prefers texts about twice as long as the question's digits."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return -(t.str.strip().str.len() - q.str.len()).abs().astype("float64")

    return score(query, body)


@check(
    "rerank",
    f"""with {near('true', 30)},
scored as (select *, -cast(abs(length(text) - length(query_text)) as double) as rerank_score from kept),
placed as (select *, row_number() over (partition by query_id order by rerank_score desc, rank) as position from scored)
select query_id, id, rerank_score, position from placed where position <= 10""",
)
def _(spark, sf):
    asked = queries(spark, sf)
    found = r.retrieve_all(corpus(spark, sf), asked, top_n=30).join(asked.select("query_id", "query_text"), "query_id")
    return r.rerank(found, length_score, 10).select("query_id", "id", "rerank_score", "position")


BLOCK = "'[SOURCE: ' || file_name || ' | ' || doc_level || ' | ' || section_id || ' | - | page - | - | ocr_used=False]' || chr(10) || text"


@check(
    "build_context",
    f"with {near('true', 10)} select query_id, string_agg({BLOCK}, chr(10) || chr(10) order by rank) as context from kept group by 1",
)
def _(spark, sf):
    return r.build_context(r.retrieve(corpus(spark, sf), queries(spark, sf)))


@check(
    "rag_query",
    f"""with {near("contains(section_id, '2')", 60)},
scored as (select *, -cast(abs(length(text) - length(query_text)) as double) as score from kept where starts_with(section_id, '2')),
placed as (select *, row_number() over (partition by query_id order by score desc, rank) as position from scored)
select query_id, string_agg({BLOCK}, chr(10) || chr(10) order by position) as context from placed where position <= 5 group by 1""",
)
def _(spark, sf):
    return rag_query(
        corpus(spark, sf), queries(spark, sf), {"section_prefix": "2"}, top_n=60, top_k=5, scorer=length_score
    )


@check(
    "collection_stats",
    """select 'total' as item, 'vectors' as name, cast(count(*) as varchar) as value from embeddings
union all select 'key', unnest(['doc_level', 'doc_name', 'section_id', 'tags', 'source_path', 'file_name']), 'true' where (select count(*) from embeddings) > 0
union all (select 'sample', cast(vec_id as varchar), 'Vector ' || vec_id || ' of ' || label from embeddings order by vec_id limit 5)""",
)
def _(spark, sf):
    return r.collection_stats(corpus(spark, sf))
