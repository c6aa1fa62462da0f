"""The queries opN_<name> and pipeline, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import near_duplicates

    return near_duplicates(C.documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(C.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import languages

    return languages(C.documents(spark, sf_dir))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(C.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), "byte", with_ids=False)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import stored

    return stored(C.documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), "word")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import edited_and_next

    return edited_and_next(C.documents(spark, sf_dir))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(C.documents(spark, sf_dir))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Queries by ids divisible by 50 against all rows; whole numbers, so sums are exact.
OP6_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
      FROM e q, e x WHERE q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(C.documents(spark, sf_dir))


def op8_sql() -> str:
    from .licenses import oracle

    return oracle()


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(C.documents(spark, sf_dir))


def op11_sql() -> str:
    from .quality import sql

    return sql()


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=moved)


def op12_sql() -> str:
    from .negatives import SQL as sql

    return sql


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(C.documents(spark, sf_dir))


def op13_sql() -> str:
    from .divergence import SQL as sql

    return sql


QUERIES = {
    f.__name__: f
    for f in (op1_near_duplicates, op2_mix_sources, op3_fingerprints, op4_languages, op5_pack, op6_top_k, op7_token_store, op8_licenses, op9_main_text, op10_secrets, op11_quality_rules, op12_hard_negatives, op13_source_divergence, pipeline)
}
def op2_sql() -> str:
    from .mixing import SQL as sql

    return sql


SQL: dict[str, str] = {"op2_mix_sources": op2_sql(), "op6_top_k": OP6_SQL, "op8_licenses": op8_sql(), "op11_quality_rules": op11_sql(), "op12_hard_negatives": op12_sql(), "op13_source_divergence": op13_sql()}
