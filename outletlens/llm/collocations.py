"""Phrase collocations per language, counted in counting quotient filters.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words
``[^\\x20\\x09]+``. A phrase is 2 to ``longest`` words in a row inside a piece; its count takes
overlaps in. Phrases with ``a >= least`` occurrences are candidates; l and r are the counts of the
two parts of a cut, and the score is floor(1000 * a * n / (l * r)) with n words in the language,
the lowest-scoring cut counting.

1. Words are counted per language. Those with fewer than ``least`` occurrences are in no candidate
   and only leave a gap. The others get dense ids (a language's words are its own ids).
2. Texts become runs of ids, written once: each run is a chunk of texts of any language.
3. Each task counts its shard's id pairs, packed and permuted, in counting quotient filters
   (``quotient``), and sends each range of leading bits to the task that merges that range of all
   shards' filters. A frequent pair is one entry per shard, and the permutation makes ranges alike.
4. Longer phrases are counted the same way, where all their pairs are frequent. That is looked up
   in a bit map of fixed size (``BITMAP_BITS``), which may let others through, never miss one.
5. Cuts, longer candidates that take a phrase in, words and ranks are joins of the frequent phrases.

Memory: a task holds ``ENTRIES`` entries of a filter, or one range of all filters (ranges are
chosen by the corpus's size). Up to ``VOCABULARY`` ids are broadcast as sorted 8-byte hashes;
a larger vocabulary is joined to the words instead. Words with equal 64-bit hashes are found, and
another seed is taken. Ids have up to 25 bits (33 million words of ``least`` occurrences).

Null texts are empty, null languages are ``und``; repeated rows count each; ties go to the phrase
in UTF-8 byte order; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outletlens.functions.ranking import with_global_rank
from outletlens.llm import quotient
from outletlens.llm.common import lean, scratch, ship, small
from outletlens.llm.hashing import mix, prefix_hash
from outletlens.llm.wordhash import kinds, word_chunks

KIND = kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
ENTRIES = 1 << 20
BITMAP_BITS = 27
VOCABULARY = 4_000_000
_CHUNK_BITS = 15                # of the bit map, in one row


def _lang_hash(lang: str, seed: int) -> np.uint64:
    return mix(prefix_hash(np.frombuffer(lang.encode("utf-8"), np.uint8))[-1:] + np.uint64(seed))[0]


def _runs(texts: list, langs: list, seed: int):
    """Per chunk of texts: bytes, word starts and ends, keys of (language, word), and whether a
    word starts a piece."""
    salt = {x: _lang_hash(x, seed) for x in set(langs)}
    for lo, n, data, starts, ends, hashes, text, piece in word_chunks(texts, KIND):
        salts = np.array([salt[x] for x in langs[lo:lo + n]], np.uint64)
        keys = mix(hashes ^ salts[text]).view(np.int64)
        yield lo, data, starts, ends, text, keys, np.diff(piece, prepend=-1) != 0


def _count_words(seed: int):
    def run(batches):
        for pdf in batches:
            texts, langs = pdf.text.tolist(), pdf.lang.tolist()
            for lo, data, starts, ends, text, keys, _ in _runs(texts, langs, seed):
                if not len(keys):
                    continue
                keys, first, n = np.unique(keys, return_index=True, return_counts=True)
                raw = data.tobytes()
                yield pd.DataFrame({"lang": [langs[lo + t] for t in text[first].tolist()],
                                    "word": [raw[a:b].decode("utf-8") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)],
                                    "key": keys, "f": n})
    return lean(run)


def _gapped(ids: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Ids with a 0 before each piece and for each run of words without id."""
    out = np.zeros(2 * len(ids), np.int32)
    out[1::2] = ids
    use = np.ones(len(out), bool)
    use[::2] = breaks
    out = out[use]
    return out[(out != 0) | (np.concatenate(([1], out[:-1])) != 0)]


def _to_ids(seed: int, known):
    def run(batches):
        keys = np.frombuffer(known.value, np.int64)
        for pdf in batches:
            for *_, here, breaks in _runs(pdf.text.tolist(), pdf.lang.tolist(), seed):
                at = np.minimum(np.searchsorted(keys, here), max(len(keys) - 1, 0))
                ids = np.where(keys[at] == here, at + 1, 0) if len(keys) else np.zeros(len(here), np.int64)
                yield pd.DataFrame({"ids": [_gapped(ids, breaks).astype("<i4").tobytes()]})
    return lean(run)


def _to_keys(seed: int):
    """The same runs as hashes, for the join with a large vocabulary: (words, breaks)."""
    def run(batches):
        for pdf in batches:
            for *_, here, breaks in _runs(pdf.text.tolist(), pdf.lang.tolist(), seed):
                yield pd.DataFrame({"words": [here], "breaks": [breaks]})
    return lean(run)


def _joined_ids(docs: DataFrame, vocabulary: DataFrame, seed: int) -> DataFrame:
    """Runs of ids through a shuffle join of all words with the vocabulary."""
    runs = scratch(docs.mapInPandas(_to_keys(seed), "words array<long>, breaks array<boolean>")
                   .withColumn("run", F.monotonically_increasing_id()), "phrase-keys")
    words = runs.select("run", F.posexplode("words").alias("at", "key"))
    ids = words.join(vocabulary.select("key", F.col("id").cast("int").alias("id")), "key", "left")
    rows = ids.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("id", F.lit(0)).alias("id")))).alias("x"))

    def gap(batches):
        for pdf in batches:
            yield pd.DataFrame({"ids": [_gapped(np.array(i, np.int64), np.array(b, bool)).astype("<i4").tobytes()
                                        for i, b in zip(pdf.ids, pdf.breaks, strict=True)]})
    return rows.join(runs.select("run", "breaks"), "run").select(F.col("x.id").alias("ids"), "breaks").mapInPandas(gap, "ids binary")


def _windows(ids: np.ndarray, n: int, width: int, bitmap):
    """Packed, permuted keys of the n-word windows without a gap (and of frequent pairs only)."""
    if len(ids) < n:
        return None
    bad = np.concatenate(([0], np.cumsum(ids == 0)))
    ok = bad[n:] == bad[:-n]
    if bitmap is not None:
        pair = np.zeros(len(ids) - 1, bool)
        both = (ids[1:] != 0) & (ids[:-1] != 0)
        at = _places(*quotient.pack([ids[:-1][both], ids[1:][both]], width))
        pair[both] = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
        rare = np.concatenate(([0], np.cumsum(pair)))
        ok &= rare[n - 1:] == rare[:len(rare) - n + 1]
    at = np.flatnonzero(ok)
    if not len(at):
        return None
    return quotient.permute(*quotient.pack([ids[at + k] for k in range(n)], width), n * width)


def _places(low, high) -> np.ndarray:
    """Bit map places of packed pairs (of 50 bits at most)."""
    return (mix(low) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _shard_filters(sizes: tuple, width: int, cut: dict, bitmap, entries: int):
    """Per task: counting quotient filters of its windows, one per range of leading bits."""
    def run(batches):
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        waiting = {n: [] for n in sizes}
        kept = {n: None for n in sizes}

        def gather(n):
            filters = [quotient.count(low, high) for low, high in waiting[n]]
            waiting[n] = []
            kept[n] = quotient.merge([*([kept[n]] if kept[n] else []), *filters])

        def pieces(n):
            rows = list(quotient.split(*kept[n], n * width, cut[n]))
            kept[n] = None
            return pd.DataFrame([(n, *r) for r in rows], columns=["n", "part", "entries", "filter"])

        for pdf in batches:
            for raw in pdf.ids:
                ids = np.frombuffer(raw, "<i4")
                for n in sizes:
                    keys = _windows(ids, n, width, bits)
                    if keys is None:
                        continue
                    waiting[n].append(keys)
                    if sum(len(k[0]) for k in waiting[n]) >= entries:
                        gather(n)
                        if len(kept[n][0]) >= entries:
                            yield pieces(n)
        for n in sizes:
            if waiting[n]:
                gather(n)
            if kept[n]:
                yield pieces(n)
    return lean(run)


def _merged(width: int, cut: dict, least: int):
    def run(key, pdf):
        n, part = map(int, key)
        low, high, counts = quotient.merge([quotient.load(part, f, n * width, cut[n]) for f in pdf["filter"]])
        use = counts >= least
        ids = quotient.unpack(*quotient.unpermute(low[use], None if high is None else high[use], n * width), width, n)
        return pd.DataFrame({"ids": pd.Series(list(ids.astype(np.int32)), dtype=object), "f": counts[use]})
    return run


def _frequent(runs: DataFrame, sizes: tuple, width: int, words: int, least: int, entries: int, bitmap=None) -> DataFrame:
    """(ids, f) of the phrases of these lengths with ``least`` occurrences."""
    cut = {n: min((words // entries).bit_length(), n * width) for n in sizes}
    shards = runs.mapInPandas(_shard_filters(sizes, width, cut, bitmap, entries), "n int, part long, entries long, filter binary")
    return shards.groupBy("n", "part").applyInPandas(_merged(width, cut, least), "ids array<int>, f long")


def _bitmap(pairs: DataFrame, width: int):
    """The bit map of frequent pairs: rows of 2**15 bits, at most 2**12 of them."""
    def place(batches):
        for pdf in batches:
            ids = np.array(pdf.ids.tolist(), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"at": _places(*quotient.pack([ids[:, 0], ids[:, 1]], width))})
    at = pairs.select("ids").mapInPandas(place, "at long")
    chunks = (at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
              .groupBy(F.shiftright("word", _CHUNK_BITS - 6).alias("chunk")).agg(F.collect_list(F.struct("word", "bits")).alias("x")))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for row in chunks.toLocalIterator():
        out[[x.word for x in row.x]] = [x.bits for x in row.x]
    return pairs.sparkSession.sparkContext.broadcast(out.astype("<i8").tobytes())


def _floor_ratio(x: Column, y: Column) -> Column:
    """floor(x / y) of decimals without fraction, exactly: a rounded quotient, mended by its product."""
    q = F.floor(x / y).cast("decimal(19,0)")
    q = F.when(q * y > x, q - 1).otherwise(q)
    return F.when((q + 1).cast("decimal(19,0)") * y <= x, q + 1).otherwise(q).cast("long")


def count_phrases(docs: DataFrame, least: int = 100, longest: int = 5, entries: int = ENTRIES,
                  vocabulary_limit: int = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary (id, lang, word, key, f), totals (lang, n) and phrases (ids, f), the latter of 1 to
    ``longest`` words and at least ``least`` occurrences."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    seed = 0
    while True:
        counted = docs.mapInPandas(_count_words(seed), "lang string, word string, key long, f long")
        words = scratch(counted.groupBy("lang", "word", "key").agg(F.sum("f").alias("f")), "phrase-words")
        if not words.groupBy("key").count().where("count > 1").take(1):
            break
        seed += 1
    totals = scratch(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals", 1)
    vocabulary = scratch(with_global_rank(words.where(F.col("f") >= least), [], ["key"], size_col=None)
                         .withColumn("id", F.col("_rank") + 1).drop("_rank"), "phrase-vocabulary")
    size = vocabulary.count()
    width = max(1, size.bit_length())
    if width > 25:
        raise ValueError(f"{size} words of {least} occurrences: ids have at most 25 bits; raise least")
    if size <= vocabulary_limit:
        keys = np.sort(np.array([r.key for r in vocabulary.select("key").toLocalIterator()], np.int64))
        runs = docs.mapInPandas(_to_ids(seed, spark.sparkContext.broadcast(keys.tobytes())), "ids binary")
    else:
        runs = _joined_ids(docs, vocabulary, seed)
    runs = scratch(runs, "phrase-runs")
    total = int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    phrases = scratch(_frequent(runs, (2,), width, total, least, entries), "phrase-pairs")
    if longest > 2:
        more = _frequent(runs, tuple(range(3, longest + 1)), width, total, least, entries, _bitmap(phrases, width))
        phrases = phrases.unionByName(scratch(more, "phrase-longer"))
    one = vocabulary.select(F.array(F.col("id").cast("int")).alias("ids"), "f")
    return vocabulary, totals, one.unionByName(phrases)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, **limits) -> DataFrame:
    """Per language its first ``top`` phrases: lang, rank, phrase, a, l, r, n, score. ``limits``: see ``count_phrases``."""
    vocabulary, totals, phrases = count_phrases(docs, least, longest, **limits)
    phrases = scratch(phrases, "phrase-all")
    count = F.size("ids")
    # a candidate of n words takes its two parts of n - 1 words in; longer ones do so by way of these
    longer = phrases.where(count > 2)
    inner = (longer.select(F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), "f")
             .groupBy("ids").agg(F.max("f").alias("outer")))
    kept = phrases.where(count > 1).join(inner, "ids", "left").where("outer IS NULL OR outer < f").select("ids", F.col("f").alias("a"))
    cuts = kept.select("ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.withColumns({"head": F.expr("slice(ids, 1, k)"), "tail": F.expr("slice(ids, k + 1, size(ids) - k)")})
    part = phrases.select(F.col("ids").alias("part"), "f")
    cuts = cuts.join(part.select(F.col("part").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(part.select(F.col("part").alias("tail"), F.col("f").alias("r")), "tail")
    of = small(vocabulary.select(F.col("id").cast("int").alias("word0"), "lang"), vocabulary)
    cuts = cuts.withColumn("word0", F.col("ids")[0]).join(of, "word0").join(small(totals), "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("score", _floor_ratio((F.col("a") * 1000).cast("decimal(19,0)") * exact("n"), exact("l") * exact("r")))
    best = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = scratch(best.select("lang", "ids", "a", "n", "cut.*").withColumn("row", F.monotonically_increasing_id()), "phrase-scores")
    spelled = (best.select("row", F.posexplode("ids").alias("at", "id"))
               .join(small(vocabulary.select(F.col("id").cast("int").alias("id"), "word"), vocabulary), "id")
               .groupBy("row").agg(F.array_join(F.expr("transform(sort_array(collect_list(struct(at, word))), x -> x.word)"), " ").alias("phrase")))
    best = best.join(spelled, "row")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first within slices of a language, so that no task ranks all of a large one
    salted = best.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(64)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB: all windows of one to five words, joined and ranked.
SQL = """
WITH pieces AS (
    SELECT lang, row_number() OVER () AS piece, p FROM (
        SELECT coalesce(lang, 'und') AS lang,
            unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
words AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS place
    FROM (SELECT lang, piece, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces)),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4, lead(w, 4) OVER p AS w5
    FROM words WINDOW p AS (PARTITION BY piece ORDER BY place)),
f AS (
    SELECT lang, 1 AS m, w AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM grams WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM grams WHERE w4 IS NOT NULL
        GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, 5, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) FROM grams WHERE w5 IS NOT NULL
        GROUP BY ALL HAVING count(*) >= 100),
parts AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
inner_ AS (
    SELECT p.lang, array_to_string(p.ws[i:j], ' ') AS phrase, max(p.f) AS f
    FROM parts p, range(1, 6) a(i), range(1, 6) b(j) WHERE j - i BETWEEN 1 AND p.m - 2 AND j <= p.m GROUP BY ALL),
kept AS (SELECT p.* FROM parts p LEFT JOIN inner_ o USING (lang, phrase) WHERE o.f IS NULL OR 100 * o.f < 100 * p.f),
cuts AS (
    SELECT k.lang, k.phrase, k.f AS a, c.k, l.f AS l, r.f AS r, t.n,
        (1000::HUGEINT * k.f * t.n) // (l.f::HUGEINT * r.f) AS score
    FROM kept k JOIN range(1, 5) c(k) ON c.k < k.m
    JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:c.k], ' ')
    JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[c.k + 1:], ' ')
    JOIN total t ON t.lang = k.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
