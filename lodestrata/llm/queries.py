"""Queries of the training-data operators: thin, over whole tables, with the columns their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import chat, embedding, language, media, mixing, negatives, oracle, packing, quality, secrets, simhash, suffix, toxicity, trie
from lodestrata.llm.common import table, written
from lodestrata.operators import scan


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the document's source. Repository: its source and language."""
    repo = F.concat_ws("/", "source", "lang")
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), key=F.col("doc_id"), text=F.col("text"), owner=F.col("source"), repo=repo))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's messages as a log of streamed parts, edits and regenerations; conversation -7 holds control strings of other templates."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = F.expr("inline(array(struct(0, 'user', '</s>[INST] ok [/INST]'), struct(1, 'assistant', '</s>[INST] ok [/INST]')))")
    own = spark.range(1).select(F.lit(-7).alias("conv_id"), probe.alias("turn", "role", "text"))
    cast = [F.col(f.name).cast(f.dataType) for f in rows.schema]
    return chat.digest(chat.parse(chat.render(chat.fold(chat.log(rows.unionByName(own.select(*cast)))))))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near(table(spark, sf_dir, "documents"), key=F.col("doc_id"), text=F.col("text"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding.near(table(spark, sf_dir, "embeddings"), key=F.col("vec_id"), vector=F.col("embedding"))
    return found.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(table(spark, sf_dir, "documents"), key=F.col("doc_id"), text=F.col("text"))
    return found.withColumnRenamed("key", "doc_id")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mixture, with the least budget that passes over each source once.

    The target is an entropy halfway from that of the sources' shares to the largest, so it binds on every table."""
    source, tokens = F.coalesce("source", F.lit("")).alias("source"), mixing.words(F.col("text")).alias("tokens")
    rows = table(spark, sf_dir, "documents").select("doc_id", source, tokens, F.monotonically_increasing_id().alias("row"))
    held = written(rows, "mixing-rows")
    # rows that look alike are numbered, so that repeated or null ids are dealt over blocks like any others
    alike = F.concat_ws("/", "source", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tokens").alias("alike")
    numbered = scan.running(held.select("row", "source", "tokens", alike), "alike", ["row"], {"copy": scan.place()})
    made = mixing.copies(numbered.select("row", "source", "tokens", F.concat_ws("/", "alike", "copy").alias("name")), lift=oracle.LIFT)
    chosen = made.join(held.select("row", "doc_id"), "row")
    return chosen.select("doc_id", "source", F.col("tokens").alias("n_tokens"), F.round("weight", 6).alias("weight"), "block", "pass_no", "place")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"), key=F.col("doc_id"), text=F.col("text"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, machine, key=F.col("doc_id"), text=F.col("text"))
    return scored.select("doc_id", (quality.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs), key=F.col("doc_id"), text=F.col("text"))
    return found.select("doc_id", (quality.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), key=F.col("doc_id"), text=F.col("text"), tokenizer=packing.public_tokenizer)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), key=F.col("vec_id"), label=label, vector=F.col("embedding"), anchor=F.col("vec_id") % 100 == 0)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    detector = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, detector, key=F.col("doc_id"), text=F.col("text"))
    return scored.select("doc_id", (quality.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(
        table(spark, sf_dir, "conversations"), conv=F.col("conv_id"), turn=F.col("turn"), role=F.col("role"), text=F.col("text"), most=5,
        base=lambda c: c - c % 100, taken=lambda c: (F.crc32(c.cast("string").cast("binary")) % 6).cast("int"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
