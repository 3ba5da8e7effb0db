"""The operators as queries over a folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.llm import (
    bpe, chat, credentials, decontaminate, langid, licenses, neardup, ngram_lm, phrases,
    quality, repeats, runs, toxicity)
from tenantlake.llm.frame import table

VOCABULARY = "byte_bpe_50k.json"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def joined_sha(column: str):
    return F.sha2(F.array_join(column, ","), 256)


def op1_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return quality.line_quality(table(spark, folder, "documents")).drop(
        "row_key", "removed_lines")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"),
                             table(spark, folder, "labels"))


def op3_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents")).drop(
        "content", "is_first")


def op4_prefix_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)],
                                "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.examples(rows.unionByName(own)))


def op5_wu_manber(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"),
                                        table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        joined_sha("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_secret_owners(spark: SparkSession, folder: str) -> DataFrame:
    found = credentials.secrets(table(spark, folder, "documents"))
    listed = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    base_listed = F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))

    def count(test):
        return F.size(F.filter("spans", test)).cast("bigint")

    def of_kind(kind):
        # One parameter: a second one, even with a default, would be given the span's number.
        return lambda s: s["kind"] == kind

    return found.select(
        "doc_id", *(count(of_kind(kind)).alias(f"n_{kind}")
                    for kind in credentials.KINDS[:3]),
        F.sha2(F.array_join(base_listed, ","), 256).alias("base_sha256"),
        F.array_join(listed, ",").alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"))


def op7_dice_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.licenses(table(spark, folder, "documents"), licenses.templates(spark))
    named = F.transform("licenses", lambda m: F.concat_ws(
        ":", m["license"], F.format_number(m["dice"], 4)))
    return found.select("doc_id", "n_notices", F.array_join(named, ",").alias("licenses"))


def op8_elias_fano_lm(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_lm.text_scores(table(spark, folder, "documents"))


def op9_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.round_trip(table(spark, folder, "documents"),
                           public_tokenizers.path(VOCABULARY))
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        joined_sha("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(table(spark, folder, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """One document in ten gets a period: with h the crc32 of its id, g = h div 10, n words and
    a = g mod n, words from `a` on become the first p = 1 + (n - a) div (3 + g mod 8) of them
    again and again. A null id is left as it is."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    hashed = docs.select(
        "doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    split = hashed.select("doc_id", "text", F.expr("h div 10").alias("g"),
                          F.when(F.col("h") % 10 == 0, words).alias("words"))
    n = F.size("words")
    placed = split.select("*", F.when(n > 0, (F.col("g") % n).cast("int")).alias("a"))
    period = (F.lit(1) + F.expr("(size(words) - a) div (3 + g % 8)")).cast("int").alias("p")
    cut = placed.select("doc_id", "text", "words", "a", period)
    period_words = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(period_words, F.ceil((n - F.col("a")) / F.col("p"))
                                     .cast("int")))
    periodic = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again),
                                    F.lit(1), n), " ")
    return cut.select("doc_id", F.when(F.col("a").isNull(), F.col("text"))
                      .otherwise(periodic).alias("text"))


def op11_lyndon_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.word_runs(with_planted_runs(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op12_stripes(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op13_seed_extend(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.without_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"),
                          lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_frequency, op2_toxicity, op3_dart_minhash, op4_prefix_targets,
           op5_wu_manber, op6_secret_owners, op7_dice_licenses, op8_elias_fano_lm,
           op9_prefix_bpe, op10_kneser_ney, op11_lyndon_runs, op12_stripes, op13_seed_extend,
           pipeline)
    return {f.__name__: f for f in own}
