"""Queries of the problems over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import cuts, leaks, neardup, packing, pairs, reading, syntax
from tallyforge.runtime import table


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    held_out = table(spark, folder, "seeds").where("split = 'heldout'").select("id", "original_prompt").join(table(spark, folder, "root_tasks").select("id", "contamination_group"), "id")
    corpora = {"expanded": (table(spark, folder, "expanded"), "record_no", "expanded_prompt"), "documents": (table(spark, folder, "documents"), "doc_id", "text")}
    return leaks.find_leaks(corpora, held_out, "contamination_group", "original_prompt")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("corpus", "record_key", "contamination_group")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Which held-out groups leaked, into how many records of each corpus, and how many words there are to remove."""
    size = F.aggregate("spans", F.lit(0), lambda n, x: n + x.end_word - x.start_word)
    return _leaks(spark, folder).groupBy("contamination_group", "corpus").agg(F.count("*").alias("records"), F.sum(size).alias("words"), F.max(size).alias("most_words"))


#: Flags that most intact responses have; the flags of single rows may be wrong.
_INTACT = "_finish_reason = 'stop' and not _truncated"


def _cut_values(spark: SparkSession, folder: str) -> DataFrame:
    return cuts.truncated_values(table(spark, folder, "llm_responses"), "response_no", "source", ["content", "reasoning_content"], _INTACT, ("finish_reason", "truncated"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut_values(spark, folder).where("cut").select(F.col("key").alias("response_no"), "field")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates each field."""
    return _cut_values(spark, folder).groupBy("source", "field").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_rate"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.source_files({
        "expanded": (table(spark, folder, "expanded").select("record_no", "evaluator_info.ref_path", "reference_solution", "metadata.repo"), "record_no", "ref_path", "reference_solution", "repo"),
        "root_tasks": (table(spark, folder, "root_tasks").select("root_no", "lineage.path", "golden", "lineage.repo"), "root_no", "path", "golden", "repo"),
        "candidates": (table(spark, folder, "candidates").select("candidate_no", "golden_path", "golden", "repo"), "candidate_no", "golden_path", "golden", "repo"),
    })


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.invalid_files(_files(spark, folder)).select("record_table", "record_key")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Invalid files per table, repository and language, with their rate."""
    keys = ["record_table", "repo", "language"]
    every = _files(spark, folder).select(*keys, F.lit(0).alias("bad"))
    bad = syntax.invalid_files(_files(spark, folder)).select(*keys, F.lit(1).alias("bad"))
    # counted together, so that no join on the repository is needed
    both = every.unionByName(bad).groupBy(*keys).agg(F.count_if(F.col("bad") == 0).alias("n_files"), F.sum("bad").alias("n_invalid"))
    return both.withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    expanded = table(spark, folder, "expanded")
    # the data sets of kernels ask for Python, the others for Verilog
    family = F.when(F.col("source_dataset").rlike("^(kernelbench|tritonbench)"), "python").when(F.col("source_dataset").isNotNull(), "verilog")
    prompts = expanded.select(F.col("record_no").alias("prompt_key"), F.col("expanded_prompt").alias("prompt"), family.alias("family"))
    own = expanded.select(F.col("record_no").alias("key"), F.col("record_no").alias("prompt_key"), F.col("reference_solution").alias("answer"), F.lit(None).cast("string").alias("source"))
    answers = table(spark, folder, "llm_responses").select(F.col("response_no").alias("key"), F.col("expanded_no").alias("prompt_key"), F.col("content").alias("answer"), "source", "finish_reason", "truncated")
    return pairs.defective_pairs(prompts, {"expanded": (own, "true", False), "response": (answers, "finish_reason = 'stop' and not truncated", True)})


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs of each kind have each defect."""
    return _pairs(spark, folder).groupBy("pair_kind", "defect").agg(F.count("*").alias("n_pairs"))


def _fields(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str, str, str]]:
    expanded = table(spark, folder, "expanded")
    candidates = table(spark, folder, "candidates").select("candidate_no", "task.parameters")
    return {"expanded_prompt": (expanded, "record_no", "expanded_prompt", "text"), "reference_solution": (expanded, "record_no", "reference_solution", "text"), "parameters": (candidates, "candidate_no", "parameters", "map")}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_pairs(_fields(spark, folder)).select("field", "key_a", "key_b")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(_fields(spark, folder))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "pack_profiles"), "profile", "capacity_tokens")


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of each profile and how full they are."""
    return _packed(spark, folder).groupBy("profile", "capacity").agg(F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("fill").alias("n_tokens"), (F.sum("fill") / F.sum("capacity")).alias("fill_rate"))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.mix(table(spark, folder, "documents"), "doc_id", "text", "source", table(spark, folder, "mix_targets"), "source", "target_weight", "max_repeats")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Reached and wanted share of each source."""
    return _mixed(spark, folder).groupBy("source").agg(F.first("target_share").alias("target_share"), F.first("reached_share").alias("reached_share"), F.first("rate").alias("rate"), F.sum("n_tokens").alias("n_tokens"), F.max("copy_no").alias("most_copies"))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "reading_labels"), "doc_id", "band", ["source", "repo"])


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    """How demanding the documents of each source and repository are."""
    share = [F.avg((F.col("band") == k).cast("double")).alias(f"band_{k}") for k in range(1, reading.BANDS + 1)]
    return _levels(spark, folder).groupBy("source", "repo").agg(F.count("*").alias("n_documents"), F.count("level").alias("n_levels"), F.avg("level").alias("mean_level"), *share)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_rates, p3_found, p3_rates, p4_found, p4_rates, p5_found, p5_groups, p6_pack, p6_fill, p7_mix, p7_shares, p8_levels, p8_profile)}


def oracle_sql() -> dict[str, str]:
    return {}
