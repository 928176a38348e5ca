"""op11: counting quotient filters and phrases against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import DOCS, edge_rows


def phrases(rows, least, longest, top):
    """The contract's rows for (lang, text) pairs, by counting every window."""
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    f, n, found = Counter(), Counter(), defaultdict(list)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = {}
    for p, a in candidates.items():
        for i in range(1, len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) - 1:
                    inside[p[0], *p[i:j]] = max(a, inside.get((p[0], *p[i:j]), 0))
    for p, a in candidates.items():
        if 100 * inside.get(p, 0) >= 100 * a:
            continue
        lang = p[0]
        cuts = [(1000 * a * n[lang] // (f[p[:k + 1]] * f[lang, *p[k + 1:]]), k, f[p[:k + 1]], f[lang, *p[k + 1:]]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(p[1:]).encode(), a, left, right))
    return sorted((lang, i, p.decode(), a, left, right, n[lang], -s) for lang, got in found.items()
                  for i, (s, _, p, a, left, right) in enumerate(sorted(got)[:top], 1))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"entries": 50}, {"vocabulary_limit": 0, "entries": 400}])
def test_random_texts(spark, limits):
    from outletlens.llm.collocations import collocations
    r = random.Random(5)
    vocabulary = ["the", "The", "of", "x", "é", "漢字", "of\tthe", "a.b", "rare!", "end?\n", "one two three", "one two three four five six"]
    rows = [(r.choice(["en", "fr", None]), " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    for least, top in ((4, 1000), (9, 5)):
        assert rows_of(collocations(df, least, 5, top, **limits)) == phrases(rows, least, 5, top)


def test_edges(spark, docs, no_docs):
    from outletlens.llm.collocations import collocations
    want = phrases([(r[2], r[1]) for r in edge_rows()], 2, 4, 50)
    assert want and rows_of(collocations(docs, 2, 4, 50)) == want
    assert rows_of(collocations(no_docs)) == []
    assert rows_of(collocations(spark.createDataFrame([(1, None, None, None, None), (2, ".,; !", "en", None, None)], DOCS))) == []


def test_large_numbers_are_exact(spark):
    from pyspark.sql import functions as F

    from outletlens.llm.collocations import _floor_ratio
    r = random.Random(1)
    rows = []
    for _ in range(300):
        y = r.randint(1, 10 ** r.randint(1, 18)), r.randint(1, 10 ** r.randint(1, 18))
        q = r.randint(0, min(10 ** 18, 10 ** 37 // (y[0] * y[1])))
        for d in (-1, 0, 1):
            x = max(0, q * y[0] * y[1] + d)
            if x < 10 ** 38:
                rows.append((str(x), str(y[0] * y[1]), x // (y[0] * y[1])))
    df = spark.createDataFrame(rows, "x string, y string, want long")
    got = df.select("want", _floor_ratio(F.col("x").cast("decimal(38,0)"), F.col("y").cast("decimal(38,0)")).alias("q"))
    assert got.where("q IS NULL OR q <> want").count() == 0


@pytest.mark.parametrize("width", [1, 7, 13, 25])
def test_filters_are_lossless(width):
    from outletlens.llm import quotient as Q
    rng = np.random.default_rng(width)
    for n in range(1, 6):
        bits = n * width
        ids = rng.integers(0, 1 << width, (400, n))
        ids = np.concatenate((ids, ids[:90], np.repeat(ids[:1], 600, 0)))
        low, high = Q.permute(*Q.pack(list(ids.T), width), bits)
        assert (Q.unpack(*Q.unpermute(low, high, bits), width, n) == ids).all()
        whole = Q.count(low, high)
        for cut in range(min(bits, 4)):
            halves = [Q.count(low[i::2], None if high is None else high[i::2]) for i in (0, 1)]
            back = Q.merge([Q.load(part, raw, bits, cut) for h in halves for part, _, raw in Q.split(*h, bits, cut)])
            assert all((a is None and b is None) or (a == b).all() for a, b in zip(back, whole, strict=True))
        keys = Q.unpack(*Q.unpermute(whole[0], whole[1], bits), width, n)
        assert dict(zip(map(tuple, keys.tolist()), whole[2].tolist(), strict=True)) == Counter(map(tuple, ids.tolist()))
