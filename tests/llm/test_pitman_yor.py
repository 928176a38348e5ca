"""op13: counts, seating and predictions against plain arithmetic."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import DOCS, edge_rows

_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate(_LOWER)) + [None]


def base(rows):
    """n_tokens, n_known, train_tokens, base_score per (doc_id, train, text)."""
    c = Counter(w for _, train, text in rows if train for w in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(i, train, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)))
            for i, train, t in rows]


def scored(spark, rows, **limits):
    from outletlens.llm.pitman_yor import score_texts
    df = spark.createDataFrame(rows, "doc_id long, train boolean, text string").repartition(3)
    return sorted((tuple(r) for r in score_texts(df, df.train, **limits).collect()), key=str)


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


def corpus(seed, n, words=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        at, text = r.randrange(words), []
        for _ in range(r.randint(0, 60)):
            at = (at * 7 + r.choice([1, 1, 1, 2, 3])) % words          # the next word depends on the last
            text.append(vocabulary[at])
        rows.append((i, i % 5 != 2, " ".join(text)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"entries": 200}])
def test_counts_and_scores(spark, limits):
    rows = corpus(1, 200)
    rows += [(1000 + i, True, "Same pair same PAIR") for i in range(150)] + [(7, False, None), (None, True, ""), (7, False, "new words here")]
    got = scored(spark, rows, **limits)
    close(got, base(rows))
    held = [g for g in got if not g[1] and g[2] > 5]
    assert sum(g[6] for g in held) > 0.8 * sum(g[5] for g in held)       # pairs tell more than words
    assert all(g[6] < 0 for g in got)


def test_single_counts_by_hand(spark):
    """Every pair once in training: each word has one table in its restaurant, and the root's customers
    are 1 each too, so nothing is left to chance."""
    rows = [(1, True, "a b c d"), (2, False, "a b x c")]
    got = {g[0]: g[6] for g in scored(spark, rows)}
    d, v = 0.95, 5                                    # n1 / (n1 + 2 n2) = 1, at most 0.95
    root = lambda known: ((1 - d if known else 0) + (1 + d * 5) / (v + 1)) / (1 + 5)

    def p(context_known, pair_known, word_known):
        if not context_known:
            return root(word_known)
        return ((1 - d if pair_known else 0) + (1 + d) * root(word_known)) / 2
    assert got[1] == pytest.approx(5 * math.log10(p(1, 1, 1)))
    # start-a, a-b, b-x, x-c, c-end
    want = [p(1, 1, 1), p(1, 1, 1), p(1, 0, 0), p(0, 0, 1), p(1, 0, 1)]
    assert got[2] == pytest.approx(sum(map(math.log10, want)))


def test_repeated_pair_by_hand(spark):
    """One pair twice: each sample has it at one or two tables, and its word at one or two in the root."""
    rows = [(1, True, "a b"), (2, True, "c a b d"), (3, False, "a")]
    got = {g[0]: g[6] for g in scored(spark, rows)}
    # types: start-a, a-b twice, b-end, start-c, c-a, b-d, d-end: 6 once, 1 twice; tokens a b c d end
    d1 = 6 / 8
    # root customers before seating: a 2, b 1, c 1, d 1, end 2
    d0, v = 3 / 7, 5

    def sample(t, root_a, root_b, root_end):
        c0, t0 = 2 + t + 1 + 1 + 2, root_a + root_b + 1 + 1 + root_end
        root = lambda c, k: (c - d0 * k + (1 + d0 * t0) / (v + 1)) / (1 + c0)
        return ((1 - d1 + (1 + d1 * 2) * root(2, root_a)) / 3) * ((1 + d1 * t) * root(2, root_end) / 3)
    values = [sample(t, a, b, e) for t in (1, 2) for a in (1, 2) for e in (1, 2) for b in range(1, t + 1)]
    # both factors are means over the samples of their own
    assert math.log10(min(values)) - 0.05 < got[3] < math.log10(max(values)) + 0.05


def exact_tables(c, others, base_p, d, theta=1.0):
    """Distribution of the tables of c customers of one word, by seating them in all ways."""
    weights = Counter()

    def sit(sizes, weight):
        if sum(sizes) == c:
            weights[len(sizes)] += weight
            return
        for k, s in enumerate(sizes):
            sit(sizes[:k] + (s + 1,) + sizes[k + 1:], weight * (s - d))
        sit((*sizes, 1), weight * (theta + d * (others + len(sizes))) * base_p)
    sit((), 1.0)
    total = sum(weights.values())
    return [weights[t] / total for t in range(1, c + 1)]


@pytest.mark.parametrize("c,others,base_p,d", [(2, 0, 0.3, 0.5), (5, 7, 0.05, 0.8), (7, 3, 0.4, 0.1)])
def test_seating_is_the_conditional(c, others, base_p, d):
    from outletlens.llm.pitman_yor import seat
    n = 40_000
    t = seat(np.full(n, c), np.full(n, others), np.full(n, base_p), d, np.random.default_rng(4))
    got = np.bincount(t, minlength=c + 1)[1:] / n
    assert np.abs(got - exact_tables(c, others, base_p, d)).max() < 0.012


def test_seating_of_many_customers():
    from outletlens.llm.pitman_yor import EXACT, seat
    rng = np.random.default_rng(1)
    c = np.array([0, 1, EXACT, EXACT + 1, 5000, 10 ** 12] * 50)
    t = seat(c, np.full(len(c), 50), np.full(len(c), 0.01), 0.7, rng).reshape(50, -1)
    assert (t[:, 0] == 0).all() and (t[:, 1] == 1).all() and (t <= np.maximum(c.reshape(50, -1), 0)).all()
    mean = t.mean(0)
    assert mean[2] <= mean[4] < mean[5] and abs(mean[3] - mean[2]) < 3


def test_edges(spark, docs, no_docs):
    from pyspark.sql import functions as F

    from outletlens.llm.common import held_out
    from outletlens.llm.pitman_yor import score_texts
    got = sorted((tuple(r) for r in score_texts(docs, ~held_out(F.col("doc_id"), 7, 2)).collect()), key=str)
    import zlib
    rows = [(r[0], not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2), r[1]) for r in edge_rows()]
    close(got, base(rows))
    assert score_texts(no_docs, F.lit(True)).collect() == []
    none = score_texts(spark.createDataFrame([(1, "a b", None, None, None)], DOCS), F.lit(False)).first()
    assert tuple(none) == (1, False, 3, 0, 0, 0.0, 0.0)


def test_texts_are_scored_in_slices(spark, monkeypatch):
    """The pairs of all texts are never shuffled at once, and a text's score does not depend on its slice,
    also where the one training text with its pair is in another slice."""
    from outletlens.llm import pitman_yor
    rows = corpus(3, 150)
    rows += [(2000 + 2 * i + k, k == 0, f"left{i} right{i} left{i + 1}") for i in range(40) for k in (0, 1)]
    rows += [(None, True, "nobody's text"), (-5, False, "nobody's text"), (-5, True, ""), (-5, False, None)]
    parts, write = [], pitman_yor.scratch

    def spy(df, name, **more):
        out = write(df, name, **more)
        if name == "lm-scores":
            parts.append(out.count())
        return out
    monkeypatch.setattr(pitman_yor, "scratch", spy)
    got = scored(spark, rows, entries=200)
    assert len(parts) > 1 and sum(parts) == len(rows) and max(parts) < 0.6 * len(rows)
    monkeypatch.setattr(pitman_yor, "SLICES", 1)
    whole = scored(spark, rows, entries=200)
    close(got, base(rows))
    key = lambda r: (str(r[:5]), round(r[6], 6))
    for g, w in zip(sorted(got, key=key), sorted(whole, key=key), strict=True):
        assert g[:5] == w[:5] and g[6] == pytest.approx(w[6], rel=1e-9)
