"""The registered queries of the training-data operators, over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from outletlens.llm import collocations, dialogues, neardup, quality_rules, sharding, substrings, url_filter
from outletlens.llm.common import held_out, table


def op9_minhash_near_dedup(spark, sf_dir):
    from outletlens.llm.neardup import near_duplicates
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs, width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op6_suffix_array_dedup(spark, sf_dir):
    from outletlens.llm.substrings import removal_digest
    return removal_digest(table(spark, sf_dir, "documents"), width=400)


def op5_line_quality_rules(spark, sf_dir):
    from outletlens.llm.quality_rules import quality_columns
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_columns(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                        "n_repeat_words", "base_failed", "kept")


def op8_sharding(spark, sf_dir):
    from outletlens.llm.sharding import interleave
    return interleave(table(spark, sf_dir, "documents"), shards=24)


def op4_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    from outletlens.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op3_language_id(spark, sf_dir):
    from outletlens.llm.langid import fit, identify
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    model = fit(docs, ~F.col("held_out"))
    return identify(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "known")


def op10_quality_classifier(spark, sf_dir):
    from outletlens.llm.quality_model import score_quality
    out = held_out(F.col("doc_id"), 3, 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", out.alias("held_out"))
    return score_quality(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"), ["doc_id", "held_out"])


def op7_url_filter(spark, sf_dir):
    from outletlens.llm.url_filter import judge_urls
    return judge_urls(table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark, sf_dir):
    import public_tokenizers

    from outletlens.llm.pieces import encode_digest
    return encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_exact_top_k(spark, sf_dir):
    from outletlens.llm.bm25 import search
    docs = table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(docs, queries, k=10)


def op11_collocations(spark, sf_dir):
    from outletlens.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op12_conversation_repair(spark, sf_dir):
    from outletlens.llm.dialogues import repair_digest
    return repair_digest(table(spark, sf_dir, "conversations"))


def op13_lm_scoring(spark, sf_dir):
    from outletlens.llm.pitman_yor import score_texts
    out = score_texts(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 7, 2))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op11_collocations": op11_collocations,
           "op12_conversation_repair": op12_conversation_repair,
           "op13_lm_scoring": op13_lm_scoring,
           "op1_exact_top_k": op1_exact_top_k,
           "op2_sentencepiece": op2_sentencepiece,
           "op7_url_filter": op7_url_filter,
           "op10_quality_classifier": op10_quality_classifier,
           "op3_language_id": op3_language_id,
           "op4_best_fit_packing": op4_best_fit_packing,
           "op8_sharding": op8_sharding,
           "op5_line_quality_rules": op5_line_quality_rules,
           "op6_suffix_array_dedup": op6_suffix_array_dedup,
           "op9_minhash_near_dedup": op9_minhash_near_dedup}
ORACLES: dict[str, str] = {"op11_collocations": collocations.SQL, "op12_conversation_repair": dialogues.SQL,
                          "op5_line_quality_rules": quality_rules.SQL, "op6_suffix_array_dedup": substrings.SQL,
                          "op7_url_filter": url_filter.SQL, "op8_sharding": sharding.SQL,
                          "op9_minhash_near_dedup": neardup.SQL}
