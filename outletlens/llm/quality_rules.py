"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: a line that fails a punctuation, navigation or
boilerplate rule is removed; then a document that lost too much of its text, or that
fails the base rules, is rejected.

Line rules (a line without words is neutral: it is neither counted nor removed):
- punctuation: at least half as many symbols ``#*$%&|<>`` or ``!`` as words, from 3
  symbols on: decorated, shouted or table-like lines;
- shouting: 4 words or more and at least 90 % of the letters in upper case;
- navigation: 3 or more cells parted by ``|``, ``»`` or tabs, of 3 words each at most;
- boilerplate: a licence, copyright, cookie or subscription notice of 20 words at most.

Base rules on the whole text: fewer than ``MIN_WORDS`` words, or more than
``MAX_REPEAT`` percent of the words inside an 8-word window found twice or more.

Defined cases: a null or empty text has no words and is rejected; equal rows get equal
verdicts; no row is dropped or merged by ``quality_columns``; columns other than text
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import let, words_of

MIN_WORDS = 20
MAX_REPEAT = 30
#: Percent of the characters in lines with words that removed lines may hold.
MAX_LOST = 50
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = (r"(?i)\b(all rights reserved|licensed under|is licensed under|released under the|terms of (use|service)"
               r"|privacy policy|cookie policy|accept (all )?cookies|copyright (\(c\)|©|[0-9]{4})|subscribe to our|sign up for our)")


def repeated_words(words: Column) -> Column:
    """Words covered by a window of 8 words that is found twice or more in the array."""
    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            # places whose window's hash also stands beside them in sorted order
            twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1), p + WINDOW) - p)),
                F.lit(0), lambda a, x: a + x))
        # most texts repeat no window: only the others sort theirs
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted))

    def of_words(w: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW))), covered)
    return F.when(F.size(words) > WINDOW, let(words, of_words)).otherwise(F.lit(0)).cast("long")


def line_passes(line: Column) -> Column:
    words = F.size(words_of(line))
    symbols = F.length(line) - F.length(F.regexp_replace(line, r"[#*$%&|<>!]", ""))
    upper = F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}", ""))
    letters = F.length(line) - F.length(F.regexp_replace(line, r"\p{L}", ""))
    cells = F.size(F.split(line, r"[|»\t]"))
    return ~(((symbols >= 3) & (2 * symbols >= words))
             | ((words >= 4) & (10 * upper >= 9 * letters) & (letters > 0))
             | ((cells >= 3) & (words <= 3 * cells))
             | ((words <= 20) & line.rlike(BOILERPLATE)))


def quality_columns(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, max_lost: int = MAX_LOST) -> DataFrame:
    """``docs`` with columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and clean_text (the lines that pass, joined)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    rest = [c for c in docs.columns if c.lower() not in names]
    words, lines = F.col("_llm_words"), F.col("_llm_lines")
    out = docs.select(*rest, words_of(text).alias("_llm_words"), F.split(text, "\n").alias("_llm_lines"))
    filled = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    passed = F.filter(lines, lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | line_passes(x))
    out = out.select(
        *rest, F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"), filled.alias("_llm_filled"), passed.alias("_llm_passed"))
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    kept_size = size(F.filter("_llm_passed", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    whole = size(F.col("_llm_filled"))
    return out.select(
        *rest, *names[:5], failed.alias("base_failed"),
        (~failed & (100 * kept_size >= (100 - max_lost) * whole)).alias("kept"), F.array_join("_llm_passed", "\n").alias("clean_text"))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
words AS (SELECT k, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
windows AS (
    SELECT k, i, array_to_string(w[i:i + 7], ' ') AS win
    FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM texts),
filled AS (
    SELECT k, line, length(line) AS size, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
        length(line) - length(regexp_replace(line, '[#*$%&|<>!]', '', 'g')) AS symbols,
        length(line) - length(regexp_replace(line, '\p{Lu}', '', 'g')) AS upper,
        length(line) - length(regexp_replace(line, '\p{L}', '', 'g')) AS letters,
        len(string_split_regex(line, '[|»\t]')) AS cells
    FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (
    SELECT k, line, size, (symbols >= 3 AND 2 * symbols >= words) OR (words >= 4 AND 10 * upper >= 9 * letters AND letters > 0)
        OR (cells >= 3 AND words <= 3 * cells) OR (words <= 20 AND regexp_matches(line, '""" + BOILERPLATE + r"""')) AS fails
    FROM filled),
by_line AS (
    SELECT k, count(*) - count(DISTINCT line) AS dup, sum(size) AS whole, coalesce(sum(size) FILTER (NOT fails), 0) AS left_
    FROM judged GROUP BY 1),
counted AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, left_, whole
    FROM texts JOIN words USING (k) LEFT JOIN repeated USING (k) LEFT JOIN by_line USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * left_ >= 50 * whole AS kept
FROM counted
"""
