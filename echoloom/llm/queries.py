"""The registered queries of the text operators and their SQL. Each covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, elias_fano, ffd_packing, fill_middle, lsh_forest, mincut_html, mixing, oracles, ownership_secrets, prefix_tokens, quality_divergence, reply_trees, spot_signatures, turn_repair
from .common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut_html.extract(_table(spark, sf_dir, "pages"))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = quality_divergence.quality_rules(_table(spark, sf_dir, "documents"))
    return t.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op3_mix_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.materialize(mixing.sized_documents(_table(spark, sf_dir, "documents")), "mix-sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


#: The contract's further conversation.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op4_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    nodes = reply_trees.materialize(reply_trees.linear_tree(turns.unionByName(more)), "chat-tree")
    return reply_trees.read_back(reply_trees.format_trees(nodes)).drop("leaf_id")


def op5_pack_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ffd_packing.digests(ffd_packing.pack(_table(spark, sf_dir, "documents")))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ownership_secrets.find_secrets(_table(spark, sf_dir, "documents"))
    count, text = ownership_secrets.count_kind, ownership_secrets.spans_text
    return found.select(
        "doc_id", *[count(F.col("base"), k).alias(f"n_{k}") for k in ownership_secrets.BASE],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), "n_live", "n_copied",
    )


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_output_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-blocks")
    elias_fano.write(_table(spark, sf_dir, "documents"), path)
    return elias_fano.read(spark, path)


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op10_jaccard_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.jaccard_join(_table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.contract_digests(_table(spark, sf_dir, "conversations"))


def op12_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.budget_answers(_table(spark, sf_dir, "documents"))


def op13_fim_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fill_middle.transform(_table(spark, sf_dir, "documents"))
    form, output = F.col("_fim.form"), F.col("_fim.output")
    return t.select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_fim.n").alias("n"), form.alias("form"), F.col("_fim.prefix_chars").alias("prefix_chars"), F.col("_fim.middle_chars").alias("middle_chars"),
        F.sha2(output, 256).alias("output_sha256"), F.sha2(fill_middle.restored(output, form), 256).alias("restored_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_html_mincut, op2_quality_divergence, op3_mix_sainte_lague, op4_chat_reply_trees, op5_pack_ffd, op6_secret_ownership, op7_quality_cotraining, op8_token_output_elias_fano, op9_spot_signatures, op10_jaccard_lsh_forest, op11_turn_repair, op12_prefix_tokens, op13_fim_streaming)}
#: op9 and op11 hash by functions SQL lacks; the others train, cut, tokenize or min-hash. Tests compare those with brute force.
ORACLE_SQL: dict[str, str] = {"op2_quality_divergence": oracles.QUALITY, "op3_mix_sainte_lague": oracles.MIX, "op4_chat_reply_trees": oracles.CHAT, "op6_secret_ownership": oracles.SECRETS, "op13_fim_streaming": oracles.FILL_MIDDLE}
