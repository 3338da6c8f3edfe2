"""The registered queries of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    counting,
    hard_negatives,
    hosts,
    katz,
    licences,
    mixing,
    multi_index,
    periodic,
    rotated_codes,
    shards,
    simhash,
    subwords,
    toxicity,
)
from corpusloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_rotated_codes(spark: SparkSession, root: str) -> DataFrame:
    def divisible(name: str):
        return F.col(name) % 50 == 0

    return rotated_codes.nearest(table(spark, root, "embeddings"), divisible, k=5)


def op2_merge_dropout(spark: SparkSession, root: str) -> DataFrame:
    return subwords.digest(table(spark, root, "documents"))


def op3_licences(spark: SparkSession, root: str) -> DataFrame:
    found = licences.scanned(table(spark, root, "documents"))
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("licences", "sentences", "unmatched")])


def op4_simhash(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, root, "documents"), radius=4, width=4)


def op5_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    model = toxicity.train(docs, table(spark, root, "labels"))
    return toxicity.graded_documents(docs, model)


def op6_katz(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")

    def held_out(doc_id: Column) -> Column:
        return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1

    return katz.scored(docs, held_out, katz.train(docs, held_out))


def op7_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixed(table(spark, root, "documents"))


def op8_multi_index(spark: SparkSession, root: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, root, "embeddings"), least=0.95)


def op9_training_order(spark: SparkSession, root: str) -> DataFrame:
    return shards.ordered(table(spark, root, "documents"))


def op10_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return counting.counted(table(spark, root, "documents"))


def op11_host_rules(spark: SparkSession, root: str) -> DataFrame:
    found = hosts.judged(table(spark, root, "documents"), F.col("source"))
    base = F.arrays_overlap("failed", F.array(*[F.lit(r) for r in hosts.BASE]))
    counts = [c for c in hosts.COUNTS if c != "n_lines"]
    return found.select("doc_id", *counts, base.alias("base_failed"), (~base & ~F.col("host_rejected")).alias("kept"), "host_rejected")


def op12_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    return periodic.digest(periodic.marked(periodic.with_planted_runs(table(spark, root, "documents"))))


def op13_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, root, "embeddings").withColumn("label", label)
    return hard_negatives.mined(rows, lambda vec_id: vec_id % 50 == 0)


def pipeline(spark: SparkSession, root: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, root)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_rotated_codes,
        op2_merge_dropout,
        op3_licences,
        op4_simhash,
        op5_toxicity,
        op6_katz,
        op7_mixing,
        op8_multi_index,
        op9_training_order,
        op10_token_counts,
        op11_host_rules,
        op12_periodic_runs,
        op13_hard_negatives,
        pipeline,
    )
}
_USABLE = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

# A sum in the order of the components, as the operator forms it.
_DOT = "list_reduce(list_transform(list_zip({}, {}), lambda p: p[1] * p[2]), lambda x, y: x + y)"

CHECKS: dict[str, str] = {
    "op1_rotated_codes": f"""WITH {_USABLE},
 s AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT.format("a.e", "b.e")} / (sqrt({_DOT.format("a.e", "a.e")}) * sqrt({_DOT.format("b.e", "b.e")})) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
 SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM t WHERE n <= 5""",
    "op3_licences": licences.check_sql(),
    "op11_host_rules": hosts.verdicts_sql(),
    "op13_hard_negatives": hard_negatives.check_sql(),
    "op8_multi_index": f"""WITH RECURSIVE {_USABLE},
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
 r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
 SELECT a AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.a) AS n_links, min(b) AS component_id, min(b) = a AS kept FROM r GROUP BY a""",
}
