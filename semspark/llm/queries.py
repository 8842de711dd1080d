"""The registered queries of this subpackage: each operator with its production parameters over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, decontamination, empirical_bayes, hilbert, html_suffix, minhash, mixing, quality_rules, spelling, tokenfiles, toolchat, trie, urlfilter
from .common import new_path, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file; the folder can be set by SEMSPARK_TOKENIZERS."""
    folder = os.environ.get("SEMSPARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_suffix.extract_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_removed_tokens")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "tokens")
    tokenfiles.write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), root)
    return tokenfiles.read_digest(spark, root)


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.apply_rules(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolchat.calls_of_conversations(table(spark, sf_dir, "conversations"))
    return toolchat.link_tool_calls(calls, results, toolchat.CONVERSATION_TOOLS)


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents"), extras=True)
    return mixed.select("doc_id", "source", "lang", "n_chars", "copy_no", "mix_key", F.md5("text").alias("text_md5"))


def op8_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = urlfilter.captures_of_pages(table(spark, sf_dir, "pages"))
    return urlfilter.filter_urls(captures, urlfilter.entries_of_captures(captures))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert.hilbert_shards(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op10_hierarchical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return empirical_bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_patricia_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.turn_sequences(table(spark, sf_dir, "conversations"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(spelling.vocabulary(table(spark, sf_dir, "documents"), one_in=97))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = bytebpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bytebpe.digest(encoded, ranks)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_suffix_array,
        op2_token_shards,
        op3_superminhash,
        op4_qgram_decontamination,
        op5_decision_list,
        op6_tool_call_linking,
        op7_poisson_mixing,
        op8_temporal_url_filter,
        op9_hilbert_shards,
        op10_hierarchical_bayes,
        op11_patricia_trie,
        op12_spelling_variants,
        op13_byte_bpe,
        pipeline,
    )
}
