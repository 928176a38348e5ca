"""A training corpus from ``documents``: five stages, each one operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The
first four return the columns of ``documents``; the last returns packed pieces.

1. language id: documents without an identified language go;
2. quality rules: rejected documents go, failing lines leave the others' text;
3. near duplicates (five-word shingles, similarity 0.8 or more): one document of each
   group stays, the one with the smallest doc_id;
4. repeated substrings of ``REPEAT_BYTES`` bytes or more leave the texts;
5. best-fit packing into sequences of at most 4096 tokens.

``n_chars`` follows the text where a stage changes it. Null texts have no language and
go in stage 1. Rows that repeat a doc_id and its text count as copies: one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from outletlens.llm.langid import UNKNOWN, fit, identify
from outletlens.llm.neardup import one_of_each
from outletlens.llm.packing import pack
from outletlens.llm.quality_rules import quality_columns
from outletlens.llm.substrings import strip_repeats
from outletlens.session import write_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a text's n-grams that the language found must know.
MIN_KNOWN = 0.2
#: Fifty words of the languages at hand are hardly ever shorter: 99 % of all runs of 51 words are longer.
REPEAT_BYTES = 200


def _columns(docs):
    return docs.select(*COLUMNS)


def language_id(spark, docs, sf_dir):
    docs = _columns(docs)
    model = fit(docs, F.lit(True))
    found = identify(docs, model, list(COLUMNS))
    return _columns(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= MIN_KNOWN)))


def quality_rules(spark, docs, sf_dir):
    judged = quality_columns(_columns(docs)).where("kept")
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source",
                         F.length("clean_text").cast("long").alias("n_chars"))


def near_dedup(spark, docs, sf_dir):
    return one_of_each(_columns(docs), width=5, percent=80)


def substring_dedup(spark, docs, sf_dir):
    out = strip_repeats(_columns(docs), REPEAT_BYTES)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark, docs, sf_dir):
    return pack(_columns(docs), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("language id", language_id),
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("repeated substrings", substring_dedup),
    ("packing", packing),
]

#: No SQL dialect expresses the tokenizer or the suffix sort; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
