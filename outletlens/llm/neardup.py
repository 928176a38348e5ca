"""Near-duplicate detection with bottom-k MinHash sketches.

One hash function orders a document's word shingles; the ``K`` smallest distinct
values are its sketch. If two documents have a Jaccard similarity of 0.8 or more,
the retained values of their union's bottom are shared with that probability each,
so some ``RUN`` consecutive values of both sketches agree except with a
probability below 1e-7 (0.8) or 1e-9 (0.85); sets smaller than ``K`` cannot miss
(where one differing value could break all runs of a small set, it posts shorter ones too).
Inverted lists over such runs of retained values give the overlaps:

1. each list links its members to its most central member (a star, never all pairs);
2. pairs pass a union-sketch estimate, then the exact Jaccard of the full sets;
3. links are closed to components. Members of lists that still hold several components
   are open: two of them can only be linked if their sets share one of their rarest
   shingles (a set of n can spare n - ceil(t n), so the n - ceil(t n) + 1 rarest suffice),
   at places that leave enough shingles behind them. Texts that differ from a common
   template in their own ways hold their own shingles first and never meet; what does
   meet across components is verified like step 2.

Rows with equal word sequences are one node, so copies cost nothing after step 0.

Defined cases: a text without words (or null) has an empty set and links with
nothing; fewer than ``width`` words make one shingle; rows that repeat a doc_id are
each judged by their own text; a null doc_id never becomes a component id unless
all ids of the component are null. Input columns other than doc_id and text are
not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import id_and_text, lean, long_id, scratch, ship, small, text_key
from outletlens.llm.components import components
from outletlens.llm.hashing import chunks, mix, prefix_hash, span_hash

K = 48
RUN = 3
#: Standard deviations of the union-sketch estimate that a pair may lie below the threshold.
SLACK = 6.0
#: Characters of text that a task hashes at once (some 40 bytes of memory each).
_CHUNK = 1 << 19


def _shingles(texts: list, width: int):
    """For each text its sorted distinct shingle hashes and a 16-byte key of its words."""
    part = [b"" if t is None else b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    full = ends > starts                       # an empty text leaves an empty word
    starts, ends = starts[full], ends[full]
    word = mix(span_hash(prefix_hash(data), starts, ends - starts) + (ends - starts).astype(np.uint64))
    edge = np.cumsum([len(w) + 1 for w in part])
    first = np.concatenate(([0], np.searchsorted(starts, edge)))
    for i, w in enumerate(part):
        a = word[first[i]:first[i + 1]]
        n = len(a) - width + 1
        if len(a) == 0:
            s = np.empty(0, np.int64)
        else:
            s = np.zeros(max(n, 1), np.uint64)
            for j in range(width if n > 0 else len(a)):
                s = mix(s + (a[j:j + n] if n > 0 else a[j:j + 1]) + np.uint64(j + 1))
            if n <= 0:
                s = mix(s + np.uint64(len(a) << 8))
            s = np.unique(s.view(np.int64))
        yield s, hashlib.blake2b(w, digest_size=16).digest()


def _parts(pdf: pd.DataFrame, width: int):
    """A batch in pieces of bounded size, each with its rows' shingles and keys."""
    texts = pdf["text"].tolist()
    for lo, hi in chunks([len(t or "") for t in texts], _CHUNK):
        yield pdf.iloc[lo:hi], _shingles(texts[lo:hi], width)


def _runs(sketch: np.ndarray, run: int = RUN) -> np.ndarray:
    """Keys of the sketch's runs of ``run`` consecutive values (of all values, if fewer)."""
    if len(sketch) == 0:
        return sketch.view(np.uint64)
    n = max(len(sketch) - run + 1, 1)
    sketch = sketch.view(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(min(run, len(sketch))):
        key = mix(key + sketch[j:j + n])
    return key


def _keys(sketch: np.ndarray, percent: int) -> np.ndarray:
    """Keys under which a sketch is listed. Sets with 2 (RUN - 1) values in common and one more
    in one of them may share no run of RUN values; if they can reach the threshold, sets of
    fewer than 2 RUN values are also listed by runs of RUN - 1."""
    most = 2 * RUN - 1
    if RUN < len(sketch) <= most and 100 * (most - 1) >= percent * most:
        return np.concatenate((_runs(sketch), _runs(sketch, RUN - 1)))
    return _runs(sketch)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (16-byte key of the word sequence), sketch, text_key (md5 of the text)."""
    def run(batches):
        for pdf in batches:
            for part, found in _parts(pdf, width):
                out = [(len(s), k, s[:K].copy()) for s, k in found]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_shingles": [o[0] for o in out], "node": [o[1] for o in out],
                                    "sketch": [o[2] for o in out], "text_key": part["text_key"].to_numpy()})
    return long_id(id_and_text(docs, text_key()).mapInPandas(
        lean(run), "doc_id string, n_shingles long, node binary, sketch array<long>, text_key binary"))


def _postings(nodes: DataFrame, percent: int) -> DataFrame:
    """Inverted lists: key, node."""
    @F.pandas_udf("array<long>")
    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda v: _keys(np.asarray(v, np.int64), percent).view(np.int64))
    return nodes.select("node", F.explode(keys("sketch")).alias("key"))


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch allows the threshold: |bottom-k of the union found in both| / k."""
    t = percent / 100
    least = max(0.0, t - SLACK * (t * (1 - t) / K) ** 0.5)
    s = nodes.select("node", "sketch")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
    both = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return (pairs.join(s.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
            .join(s.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
            .where(both >= F.lit(least) * F.size(union)).select("a", "b"))


def _full_sets(ends: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, full (all shingle hashes) of the nodes in the scratch table ``ends`` (node, doc_id)."""
    def run(batches):
        for pdf in batches:
            for _, found in _parts(pdf, width):
                out = list(found)
                yield pd.DataFrame({"node": [k for _, k in out], "full": [s for s, _ in out]})
    ids = ends.select(F.col("doc_id").alias("end_id")).distinct()
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(small(ids, ends), F.col("doc_id").eqNullSafe(F.col("end_id")), "left_semi").select("text")
            .mapInPandas(lean(run), "node binary, full array<long>")
            .join(ends.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold (100 * common >= percent * union)."""
    common = F.size(F.array_intersect("fa", "fb"))
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("full").alias("fa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("full").alias("fb")), "b")
            .where(100 * common >= percent * (F.size("fa") + F.size("fb") - common)).select("a", "b"))


def _rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, token, at: of each set's n - ceil(t n) + 1 rarest shingles those found in another
    set too, with their places (from 0) in the set's order by rarity."""
    tokens = sets.select("node", F.size("full").alias("n"), F.explode("full").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = tokens.join(often, "token").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("shared"))
    # shingles of one set only are the rarest of all and match nothing
    alone = F.col("n") - F.size("shared")
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    return shared.where(length > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), length)).alias("at", "t")).select(
        "node", "n", F.col("t.token").alias("token"), (F.col("alone") + F.col("at")).alias("at"))


def _can_link(x: str, y: str, percent: int):
    """Whether two sets whose first common shingle is at these places can reach the threshold:
    only the shingles from there on can be common."""
    most = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
    return (100 + percent) * most >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest linked doc_id),
    kept (doc_id is the component_id), component (a key of the component; null for
    empty sets), text_key."""
    ship(docs.sparkSession)
    rows = scratch(sketches(docs, width), "neardup-rows")
    nodes = scratch(rows.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")),
        "neardup-nodes")
    posted = _postings(nodes, percent)
    # written first: a join of two plain shuffles is one whose hot keys can be split
    lists = scratch(posted.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "neardup-keys")
    listed = scratch(posted.join(lists, "key"), "neardup-lists")

    # 1. stars: each list's members against the most central member of about their size, the
    # one whose other lists are the longest: what differs least from a common template
    size = F.floor(F.log(F.col("n")) / float(-np.log(percent / 100))).cast("int")
    central = listed.groupBy("node").agg(F.sum("members").alias("central"))
    sized = listed.join(nodes.select("node", "n", size.alias("size")), "node").join(central, "node")
    heads = sized.groupBy("key", "size").agg(F.max(F.struct("central", "node"))["node"].alias("head"), F.count("*").alias("among")).where("among > 1")
    stars = sized.join(heads, ["key", "size"]).where(F.col("head") != F.col("node")).select(
        F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    pairs = scratch(_estimated(stars, nodes, percent), "neardup-pairs", rows=listed.count() // 4)
    ends = scratch(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id"), "node"),
                   "neardup-ends", rows=pairs.count())
    sets = scratch(_full_sets(ends, docs, width), "neardup-sets", rows=20 * ends.count())
    links = scratch(_verified(pairs, sets, percent), "neardup-links", rows=pairs.count())
    label = components(links)

    # 2. what the stars leave open: members of lists that hold several components
    part = listed.join(label.withColumnRenamed("id", "node"), "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    open_ = part.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    part = part.join(open_, "key").select("node", "component").distinct()
    open_ = scratch(part.join(nodes.select("node", "doc_id"), "node"), "neardup-open", rows=listed.count() // 8)
    sets = scratch(_full_sets(open_, docs, width), "neardup-open-sets", rows=20 * open_.count())
    rare = scratch(_rare_prefixes(sets, percent).join(open_.select("node", "component"), "node"), "neardup-rare", rows=20 * open_.count())
    mixed = rare.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    rare = rare.join(mixed, "token")
    x, y = rare.alias("x"), rare.alias("y")
    cross = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node"))
                    & (F.col("x.component") != F.col("y.component")) & _can_link("x", "y", percent))
             .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    more = _verified(_estimated(cross, nodes, percent), sets, percent)
    label = components(links.unionByName(more))

    # 3. smallest doc_id of each component
    named = nodes.select("node", "doc_id").join(label.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("node", "component", "component_id")
    out = rows.drop("sketch").join(named, "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "component", "text_key")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the
    smallest doc_id (then the smallest text key) stays; texts without words all stay,
    but for repeated rows."""
    near = scratch(near_duplicates(docs, width, percent), "neardup-result")
    first = near.where("n_shingles > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")).select("first.doc_id", "first.text_key")
    stay = first.unionByName(near.where("n_shingles = 0").select("doc_id", "text_key").distinct())
    stay = scratch(stay.select(F.col("doc_id").alias("_llm_id"), F.col("text_key").alias("_llm_stay")), "neardup-stay")
    rows = docs.withColumn("_llm_key", text_key())
    rows = rows.join(small(stay), F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_key") == F.col("_llm_stay")), "left_semi")
    repeated = near.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():       # without repeated rows this would only move the texts
        rows = rows.dropDuplicates(["doc_id", "_llm_key"])
    return rows.drop("_llm_key")


#: All pairs that share a shingle, and the links' transitive closure (doc_ids are unique).
SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS x, b AS y FROM either UNION SELECT r.x, e.b FROM reach r JOIN either e ON e.a = r.y),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
    doc_id <= coalesce(y, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON x = doc_id
"""
