"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lurewatch.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_best_two_fit(spark, sf):
    from lurewatch.llm.packing import pack_documents

    return pack_documents(read(spark, sf, "documents", "doc_id", "text"), tokenizer_path())


@query
def op9_compression_quality(spark, sf):
    from lurewatch.llm.quality import quality_scores

    docs = read(spark, sf, "documents", "doc_id", "text")
    return quality_scores(docs, read(spark, sf, "labels", "doc_id", "quality"))


@query
def op7_cross_parsing_language(spark, sf):
    from lurewatch.llm.language import language_predictions

    return language_predictions(read(spark, sf, "documents", "doc_id", "text", "lang"))


@query
def op3_wu_manber_decontamination(spark, sf):
    from lurewatch.llm.decontamination import contamination

    return contamination(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "benchmark", "item_id", "text"))


@query
def op2_randomness_secrets(spark, sf):
    from lurewatch.llm.secrets import secret_spans

    return secret_spans(read(spark, sf, "documents", "doc_id", "text"))


@query
def op10_grouped_prefix_join(spark, sf):
    from lurewatch.llm.near_duplicates import near_duplicates

    return near_duplicates(read(spark, sf, "documents", "doc_id", "text"))


@query
def op4_line_hashing(spark, sf):
    from lurewatch.llm.line_dedup import repeated_units

    # Every line that is not blank counts, short ones (navigation, licence headings) included.
    return repeated_units(read(spark, sf, "documents", "doc_id", "text"), least_words=1)


@query
def op5_seekable_warc(spark, sf):
    from lurewatch.llm.warc import archived_pages

    return archived_pages(read(spark, sf, "pages", "page_id", "url", "html"))


@query
def op8_black_box_chat(spark, sf):
    from lurewatch.llm.chat import formatted_conversations, with_hostile_conversation

    return formatted_conversations(with_hostile_conversation(read(spark, sf, "conversations")))


@query
def op1_cross_polytope_search(spark, sf):
    from lurewatch.llm.neighbours import search

    return search(read(spark, sf, "embeddings", "vec_id", "embedding"), "vec_id % 20 = 0")


@query
def op11_two_tier_token_counts(spark, sf):
    from lurewatch.llm.token_counts import token_counts

    return token_counts(read(spark, sf, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


@query
def op13_time_forward_manifest(spark, sf):
    from lurewatch.llm.manifest import tampered_manifest

    return tampered_manifest(read(spark, sf, "documents", "doc_id", "source", "lang", "n_chars", "text"))


@query
def op12_deepening_repair(spark, sf):
    from lurewatch.llm.repair import repaired_after_damage

    return repaired_after_damage(read(spark, sf, "conversations", "conv_id", "turn", "role", "text"))
