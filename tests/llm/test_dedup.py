"""op6 (repeated substrings) and op9 (near-duplicates) against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import DOCS, edge_rows, prose


def removed(texts, width):
    """(bytes, removed, spans, sha256 of the rest) of each text, by comparing all strings."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen = Counter(r[i:i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - width + 1):
            if seen[r[i:i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def digest(df, width):
    from outletlens.llm.substrings import removal_digest
    out = removal_digest(df, width).toPandas()
    return sorted(out[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None))


def test_substrings_edges(docs, no_docs):
    short = docs.where("doc_id is null or doc_id < 100")
    texts = [t for i, t, *_ in edge_rows() if i is None or i < 100]
    assert digest(short, 400) == sorted(removed(texts, 400))
    assert digest(no_docs, 400) == []


@pytest.mark.parametrize("width,group", [(400, 2048), (100, 3), (70, 1)])
def test_substrings_random(spark, monkeypatch, width, group):
    from outletlens.llm import substrings
    monkeypatch.setattr(substrings, "GROUP", group)      # forces anchors to be split by distance
    r = random.Random(width)
    parts = [prose(i, r.randint(5, 120)) for i in range(12)]
    texts = [" ".join(r.choices(parts, k=r.randint(1, 4))) + prose(100 + i, r.randint(0, 30)) for i in range(60)]
    texts += ["a" * 1000, "ab" * 300, "a" * 450, texts[0], texts[0]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert digest(df, width) == sorted(removed(texts, width))


def test_substrings_passage_in_hundreds_of_contexts(spark):
    """More different runs of one anchor than one bucket takes, at the default limit."""
    from outletlens.llm import substrings
    r = random.Random(9)
    noise = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    long, short = noise(430), noise(150)
    texts = [noise(r.randint(0, 200)) + long + noise(r.randint(0, 120)) for _ in range(substrings.GROUP + 90)]
    texts += [noise(r.randint(260, 300)) + short + noise(r.randint(0, 200)) for _ in range(40)]
    texts += [texts[0], long[:399], long[:400]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert digest(df, 400) == sorted(removed(texts, 400))


def test_substrings_hot_anchor_meets_runs_of_any_length(spark, monkeypatch):
    """One passage in many contexts, some of them so short that a run has few windows."""
    from outletlens.llm import substrings
    monkeypatch.setattr(substrings, "GROUP", 4)
    monkeypatch.setattr(substrings, "BUCKET", 1)
    r = random.Random(6)
    passage = prose(900, 90)[:430]
    texts = [prose(i, 60)[:r.randint(0, 200)] + passage + prose(200 + i, 60)[:r.randint(0, 200)] for i in range(40)]
    texts += [passage[i:i + 400 + i % 3] for i in range(0, 28, 3)]
    texts += [prose(i, 60)[:150] + passage[100:380] + prose(400 + i, 60)[:150] for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert digest(df, 400) == sorted(removed(texts, 400))


def test_substrings_near_copies_are_not_listed_window_by_window(spark, monkeypatch):
    """Near copies of one text, more than a bucket takes: equal results, and rows in proportion to the runs."""
    from outletlens.llm import substrings
    monkeypatch.setattr(substrings, "GROUP", 8)
    rows, scratch = Counter(), substrings.scratch

    def counted(df, name, *more):
        out = scratch(df, name, *more)
        rows[name] += out.count()
        return out
    monkeypatch.setattr(substrings, "scratch", counted)
    r = random.Random(12)
    base, texts = prose(77, 400)[:1500], []
    for i in range(120):
        at = r.randint(0, 1490)
        texts.append(base[:at] + f"#{i}#" + base[at + 4:])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert digest(df, 400) == sorted(removed(texts, 400))
    assert rows["substr-seen"] < 50 * len(texts)


def test_suffix_sort_orders_like_bytes():
    from outletlens.llm.hashing import prefix_hash
    from outletlens.llm.substrings import suffix_sort
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    place = r.permutation(2900)[:1500]
    group = np.sort(r.integers(0, 40, 1500))
    order = suffix_sort(data, prefix_hash(data), place, group, 50)
    for g in range(40):
        mine = [data[place[i]:place[i] + 50].tobytes() for i in order if group[i] == g]
        assert mine == sorted(mine) and len(mine) == (group == g).sum()


def test_strip_repeats_keeps_characters_whole(spark, docs):
    from outletlens.llm.substrings import strip_repeats
    out = {r["doc_id"]: r for r in strip_repeats(docs.where("doc_id in (4, 8, 10)"), 400).collect()}
    assert out[4]["text"] is None and out[4]["score"] == "clash"
    assert len(out[10]["text"]) < 400 and "�" not in out[10]["text"]


def sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode("utf-8", "surrogatepass").lower())
        out.append({tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def groups(ids, texts, width, percent):
    """(doc_id, set size, component id) of each row, from all pairs that share a shingle."""
    s = sets(texts, width)
    parent = list(range(len(ids)))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a
    where = defaultdict(list)
    for i, x in enumerate(s):
        for g in x:
            where[g].append(i)
    shared = Counter((i, j) for rows in where.values() for j in rows for i in rows if i < j)
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(s[i]) + len(s[j]) - n):
            parent[top(j)] = top(i)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(x, least.get(top(i), x))
    return [(x, len(s[i]), least.get(top(i)) if s[i] else x) for i, x in enumerate(ids)]


def check(df, rows, width, percent):
    from outletlens.llm.neardup import near_duplicates
    out = near_duplicates(df, width, percent).collect()
    none = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(none((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out)
    assert got == sorted(map(none, groups([i for i, _ in rows], [t for _, t in rows], width, percent)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_edges(docs, width, percent):
    check(docs, [(i, t) for i, t, *_ in edge_rows()], width, percent)


def test_near_duplicates_of_one_template(spark):
    """Hundreds of texts that differ from one template in their own ways: many links, many near misses."""
    r = random.Random(9)
    rows = []
    for i in range(300):
        w = prose(1, 150).split()
        for _ in range(r.randint(0, 9)):
            w[r.randrange(150)] = f"own{i}x{r.randrange(40)}"
        rows.append((1000 - i, " ".join(w)))
    passage = prose(2, 60)
    rows += [(2000 + i, passage + " " + prose(50 + i, r.randint(3, 40))) for i in range(100)]
    rows += [(3000 + i, "a b") for i in range(5)] + [(3100, "A  b"), (3200, "a b a b a b a b"), (3201, "a b a b a b a b a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(df, rows, 3, 85)


def test_near_duplicates_of_few_words(spark):
    """8 words and the same 8 with one more: sets of 4 and 5 shingles, exactly 0.8 alike."""
    rows = []
    for i in range(60):
        w = [f"w{i}x{j}" for j in range(9)]
        rows += [(2 * i, " ".join(w[:8])), (2 * i + 1, " ".join(w))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, 5, 80)


def test_one_of_each(spark, docs, no_docs):
    from outletlens.llm.neardup import one_of_each
    out = one_of_each(docs, 3, 85).collect()
    ids = [r["doc_id"] for r in out]
    assert sorted(i for i in ids if i in (1, 2, 3)) == [1]
    assert {4, 5, 6, 7, 8, 9} <= set(ids) and ids.count(None) == 2 and out[0]["score"] == "clash"
    assert one_of_each(no_docs).count() == 0


def test_components_of_long_chains(spark):
    from outletlens.llm.components import components
    r = random.Random(1)
    order = list(range(200))
    r.shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(199)] + [(500, 501), (501, 502), (7, 7)]
    out = {x["id"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(200)}, 500: 500, 501: 500, 502: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_docs_schema_is_that_of_documents(spark):
    assert spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema.simpleString() == spark.createDataFrame([], DOCS).schema.simpleString()
