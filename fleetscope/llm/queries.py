"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import chunking, fmindex, hpylm, infill, mixing, packing, pivots, quality, secrets, simhash, suffixes, urls, winnowing
from fleetscope.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind(kind: str):
    return lambda x: x.startswith(kind)


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(simhash.fingerprints(table(spark, sf_dir, "documents"), width=3, seed=42), radius=3)
    return found.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train_on_documents(docs))
    kinds = [F.size(F.filter("base", _kind(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(
        "doc_id", *kinds, F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"), F.concat_ws(",", "spans").alias("spans")
    )


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        quality.base_failed().alias("base_failed"), (~quality.base_failed() & F.col("kept")).alias("kept"), "p_good",
    )


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2, size=1024)
    return packing.pack(found, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_source_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weight=lambda k, _: k % 3 + 1)
    return mix.rows.select("doc_id", "size", "source_size", "target", "taken", "shards")


@query("op10_document_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.compare_with_next(table(spark, sf_dir, "documents"))


# The rules of the contract.
URL_RULES = [
    urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow"),
]


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = urls.with_parts(table(spark, sf_dir, "pages").select("page_id", "url")).withColumn("match", urls.matching_rule(URL_RULES))
    # The rules are the labels; what they say nothing about is judged and teaches nothing.
    labelled = parts.where("match is not null").withColumn("label", (F.col("match.action") == "block").cast("double"))
    judged = urls.verdicts(parts, urls.train(labelled))
    verdict = F.coalesce("match.action", F.when(F.col("block"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("match.name").alias("rule"), verdict.alias("verdict"))


@query("op8_language_model_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"))


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.remove_repeats(table(spark, sf_dir, "documents"), window=35).drop("kept")


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_copied(table(spark, sf_dir, "documents"), window=50).drop("kept")


@query("op11_centroid_clustering")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.with_inertia(pivots.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, size=64, scale=1024, seed=3))


@query("op12_fill_in_middle")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored("output", "form"), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query("op13_benchmark_decontamination")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, gram=5)
