"""op1 (BM25), op2 (SentencePiece), op4 (packing), op8 (sharding) against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import DOCS, edge_rows, prose

P = pytest.importorskip("public_tokenizers")


def test_bm25_equals_brute_force(spark):
    from pyspark.sql import functions as F

    from outletlens.llm.bm25 import search, words
    texts = [prose(i, random.Random(i).randint(1, 80)) for i in range(300)] + [None, "", prose(0, 30), prose(0, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = search(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"), k=7).toPandas()
    bags = [Counter(words(t)) for t in texts]
    sizes = [sum(b.values()) for b in bags]
    mean, df, n = sum(sizes) / len(sizes), Counter(w for b in bags for w in b), len(bags)
    for q in range(0, len(texts), 50):
        score = {d: sum(c * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * s / mean))
                        for w, c in bags[q].items() if w in b) for d, (b, s) in enumerate(zip(bags, sizes, strict=True))}
        best = sorted((d for d in score if score[d] > 0), key=lambda d: (-round(score[d], 9), d))[:7]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.doc_id.tolist() == best
        assert np.allclose(mine.score, [score[d] for d in best])


def test_bm25_edges(spark, docs, no_docs):
    from pyspark.sql import functions as F

    from outletlens.llm.bm25 import search
    asked = docs.select(F.col("doc_id").alias("query_id"), "text")
    found = search(docs, asked.where("query_id in (1, 4, 5)"), k=3).toPandas()
    assert set(found.query_id) == {1} and found.doc_id.tolist() == [1, 2, 2]
    assert search(no_docs, asked, k=3).count() == 0
    assert search(docs, asked.limit(0), k=3).count() == 0


def test_bm25_null_and_repeated_query_ids(spark, monkeypatch):
    """Each query row has its own results, whatever block it falls into."""
    from outletlens.llm import bm25
    monkeypatch.setattr(bm25, "QUERY_CHARS", 40)
    texts = ["red green blue", "green blue black", "black white grey", "white white snow"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red"), (7, "snow"), (7, "grey"), (7, "grey"), (None, "black"), (None, "blue")], "query_id long, text string")
    got = sorted((str(r.query_id), r.rank, r.doc_id) for r in bm25.search(docs, asked, k=5).collect())
    assert got == sorted([("7", 1, 0), ("7", 1, 3), ("7", 1, 2), ("7", 1, 2), ("None", 1, 1), ("None", 2, 2), ("None", 1, 0), ("None", 2, 1)])


def test_block_pruning_keeps_the_best():
    from outletlens.llm.bm25 import Queries, Shard
    texts = [prose(i, 40) for i in range(2000)]
    q = Queries([0, 1], [prose(7, 3), prose(8, 50)])
    q.weigh(2000, 40.0, np.full(len(q.weight), 50.0))
    shard = Shard(q, *q.postings(texts))
    assert (shard.row >= 0).any() and (shard.row < 0).any()
    for (terms, counts), sums in zip(q.bags, shard.frequent(q.bags), strict=True):
        everything = shard.exact(terms, counts, np.arange(2000))
        docs, scores = shard.search(terms, counts, sums, 0.0, 5)
        assert sorted(scores)[-5:] == sorted(everything)[-5:]
        assert (everything[docs] == scores).all()


def test_pieces_equal_the_library():
    sp = pytest.importorskip("sentencepiece")
    from outletlens.llm import pieces
    path = P.path("piece_bpe_32k.model")
    model, lib = pieces.load(path), sp.SentencePieceProcessor(model_file=path)
    texts = [t or "" for _, t, *_ in edge_rows()] + [" a", "a ", "a  b", "  ", " " * 40 + "x", "x" * 300, "a▁b", "\n\n  c\t", "ﬁ½ \xa0"]
    for t, raw in zip(texts, pieces.Encoder(model).encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(t)
        assert pieces.decode(model, raw) == t.replace("▁", " ")


def test_viterbi_equals_dynamic_programming():
    from outletlens.llm.pieces import Pieces, _code, viterbi
    r = random.Random(5)
    texts = {"".join(r.choices("abc", k=r.randint(1, 4))) for _ in range(40)} | {"a", "b"}
    scores = {t: -r.random() * 5 for t in texts}
    p = Pieces([(i, t, scores[t]) for i, t in enumerate(sorted(texts))], 0, [])
    words = ["".join(r.choices("abcd", k=9)) for _ in range(200)]
    lone = min(scores.values()) - 10

    def best(w):
        top = [0.0]
        for j in range(1, len(w) + 1):
            top.append(max(top[i] + scores.get(w[i:j], lone if j - i == 1 else -math.inf) for i in range(max(0, j - p.longest), j)))
        return top[-1]
    for w, ends in zip(words, viterbi(p, _code("".join(words)).reshape(-1, 9)), strict=True):
        cuts = [0, *(np.flatnonzero(ends) + 1)]
        assert cuts[-1] == 9
        assert math.isclose(sum(scores.get(w[a:b], lone) for a, b in zip(cuts, cuts[1:], strict=False)), best(w))


def test_sentencepiece_query(spark, docs, no_docs):
    from outletlens.llm.pieces import encode_column, encode_digest
    path = P.path("piece_bpe_32k.model")
    out = encode_digest(docs, path).toPandas()
    assert len(out) == len(edge_rows()) and out.round_trip.all()
    ids = encode_column(docs, path).select("doc_id", "llm_ids").where("doc_id in (4, 5)").collect()
    assert all(r["llm_ids"] == [] for r in ids)
    assert encode_digest(no_docs, path).count() == 0


def test_packing(spark, docs, no_docs):
    from tokenizers import Tokenizer

    from outletlens.llm.packing import pack, sum_of_squares
    path = P.path("word_bpe_49k.json")
    out = pack(docs, path, capacity=512, end_id=1).toPandas()
    tok = Tokenizer.from_file(path)
    want = []
    for i, t, *_ in edge_rows():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i or -1, k // 512, k, len(ids[k:k + 512]), zlib.crc32(ids[k:k + 512].tobytes())) for k in range(0, len(ids), 512)]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = pack(docs, path, capacity=512, end_id=1).select(*cols).collect()
    assert sorted(want) == sorted(tuple(-1 if x is None else x for x in r) for r in got)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 512
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 512) + 2
    assert pack(no_docs, path).count() == 0
    where, offset = sum_of_squares(np.array([4, 3, 1]), 4)
    assert len(set(where)) == 2 and where[1] == where[2] and offset.tolist() == [0, 0, 3]


def test_sharding(spark, docs, no_docs):
    from outletlens.llm.sharding import interleave
    out = interleave(docs, shards=4).toPandas()
    want = sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows())
    got = interleave(docs, shards=4).select("doc_id", "size", "text_crc32").collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == want
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert interleave(no_docs).count() == 0


def test_sharding_keeps_the_mixture(spark, monkeypatch):
    from outletlens.llm import sharding
    monkeypatch.setattr(sharding, "SLICE_ROWS", 50)
    rows = [(i, "x", "en", "big" if i % 3 else f"s{i % 7}", 1) for i in range(2000)]
    out = sharding.interleave(spark.createDataFrame(rows, DOCS), shards=8).toPandas()
    share = out.groupby(["source", "shard"]).size().unstack(fill_value=0)
    spread = share.max(axis=1) - share.min(axis=1)
    assert (spread.drop("big") <= 1).all() and spread["big"] <= len(spread) - 1      # it fills what the others' rounding leaves
    again = sharding.interleave(spark.createDataFrame(rows[::-1], DOCS).repartition(5), shards=8).toPandas()
    assert out.set_index("doc_id").slot.sort_index().equals(again.set_index("doc_id").slot.sort_index())
