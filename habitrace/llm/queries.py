"""The registered query of each operator: thin, over whole tables.

Every callable takes (spark, sf_dir). SQL is given where DuckDB can express the
result; the others are tested against brute force in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitrace.llm import chat, decontaminate, embed_dedup, fill_middle, html_extract, license_scan, mixing, quality_rules, simhash, token_edits, tokenbin, toxicity, turn_repair
from habitrace.llm.store import table, written
from habitrace.llm.wordbpe import encoder_of

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Rank file of the edit-aware counts.
RANKS = "byte_bpe_50k.tiktoken"


def _tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.withColumn("probability", F.round("probability", 6))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenbin.write_shards(docs, word_encoder, END_ID, 2)
    return tokenbin.read_shards(spark, path, digest=True)


def word_encoder() -> Callable[[list[str]], list[bytes]]:
    """In a worker: texts to the ids of the tokenizer file that every node has."""
    encode = encoder_of(_tokenizer_path()).encode
    return lambda texts: list(map(encode, texts))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_rules.score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (~quality_rules.in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's trees are stored; the round of edits then reads them and encodes what it touches."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks, pattern = _tokenizer_path(RANKS), public_tokenizers.PATTERN
    trees = written(token_edits.build_trees(docs, ranks, pattern), "trees")
    edits = token_edits.revision(F.col("doc_id"), F.col("n_chars"))
    return token_edits.counts_of(token_edits.apply_edits(trees, edits, ranks, pattern))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(written(chat.format_examples(rows), "chat"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.with_digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(rows), rows)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": op1_html,
        "op2_decontaminate": op2_decontaminate,
        "op3_simhash": op3_simhash,
        "op4_embeddings": op4_embeddings,
        "op5_mixing": op5_mixing,
        "op6_token_shards": op6_token_shards,
        "op7_quality": op7_quality,
        "op8_token_counts": op8_token_counts,
        "op9_chat": op9_chat,
        "op10_licenses": op10_licenses,
        "op11_fill_middle": op11_fill_middle,
        "op12_turn_repair": op12_turn_repair,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.oracle_sql(), "op11_fill_middle": fill_middle.oracle_sql(), "op12_turn_repair": turn_repair.oracle_sql()}
