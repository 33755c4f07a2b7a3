"""The operators applied to the given tables: one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfscope.llm import (
    decontaminate, langid, linerules, merkle, packing, pii, quality, repair, secrets, sharding,
    simhash, toxicity, urlrules,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    away = langid.held_out("doc_id", 2, 4)
    learned = langid.profiles(docs.filter(~away))
    found = langid.identify(docs, learned)
    return found.select("doc_id", away.alias("held_out"), "lang_pred", "score")


def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.judged(_table(spark, sf_dir, "documents"), with_text=False)


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def _digest(found: DataFrame) -> DataFrame:
    digest = F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256")
    counts = [c for c in found.columns if c.startswith("n_")]
    return found.select("doc_id", *counts, digest, "spans")


def pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.scan(_table(spark, sf_dir, "documents")))


def secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.scan(_table(spark, sf_dir, "documents")))


def quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    away = langid.held_out("doc_id", 0, 5)
    trees = quality.learn(docs, labels.filter(~away))
    sure = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return quality.scored(docs, trees).select("doc_id", away.alias("held_out"), "score", sure)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, items)


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filtered(_table(spark, sf_dir, "pages"))


def lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(_table(spark, sf_dir, "documents"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    away = langid.held_out("doc_id", 0, 5)
    # null: the row is not tampered with
    tampered = F.when(away, merkle.leaf([F.col(n) for n in names[:-1]] + [lower]))
    found = merkle.manifest(
        docs, [F.col(n) for n in names], F.col("source"), F.col("doc_id"),
        F.struct("doc_id", tampered.alias("tampered")),
    )
    folded = merkle.fold(F.col("path"), F.coalesce("data.tampered", "leaf"))
    proof = merkle.digest(merkle.siblings(F.col("path")))
    return found.select(
        "data.doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    away = langid.held_out("doc_id", 0, 5)
    model = toxicity.learn(docs, labels.filter(~away))
    sure = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return toxicity.scored(docs, model).select("doc_id", away.alias("held_out"), "score", sure)


def _damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults by the checksum of ``conv_id:turn``; nulls are one space there."""
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    text = F.coalesce("text", space)
    code = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    role = F.when(code == 4, "user").otherwise(F.coalesce("role", space))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.expr("array_repeat(0, times)")).alias("x")).drop("x")


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    done = repair.repair(_damaged(turns))
    out = turns.select("conv_id").distinct()
    for found in (done.report, repair.written_sha256(done.rows)):
        out = out.join(found, F.col("conv_id").cast("string").eqNullSafe(F.col("conv")), "left").drop("conv")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_language_id": language_id,
    "op2_line_rules": line_rules,
    "op3_simhash_dedup": simhash_dedup,
    "op4_pii_anchors": pii_anchors,
    "op5_secret_novelty": secret_novelty,
    "op6_quality_trees": quality_trees,
    "op7_best_fit_packing": best_fit_packing,
    "op8_benchmark_decontamination": benchmark_decontamination,
    "op9_url_filters": url_filters,
    "op10_lookup_sharding": lookup_sharding,
    "op11_merkle_manifest": merkle_manifest,
    "op12_toxicity_automata": toxicity_automata,
    "op13_conversation_repair": conversation_repair,
}
