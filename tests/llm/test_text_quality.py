"""op3 (language id), op5 (quality rules), op7 (url filter), op10 (quality classifier)."""

import re
from collections import defaultdict

import numpy as np
import pandas as pd

from tests.llm.conftest import edge_rows

SMALL = "/root/testdata/sf0.01"


def test_language_id_held_out(spark):
    from outletlens.llm.queries import QUERIES
    out = QUERIES["op3_language_id"](spark, SMALL).toPandas().set_index("doc_id")
    truth = pd.read_parquet(f"{SMALL}/documents.parquet").set_index("doc_id").lang
    held = out[out.held_out]
    assert len(out) == len(truth) and 0.2 < len(held) / len(out) < 0.3
    assert (held.lang_pred == truth[held.index]).mean() >= 0.99
    assert out.score.between(0, 1).all()


def test_language_id_edges(spark, docs, no_docs):
    from pyspark.sql import functions as F

    from outletlens.llm.langid import fit, identify
    model = fit(docs, F.lit(True))
    assert model.languages == ["en"]
    out = identify(docs, model, ["doc_id", "score"]).toPandas()
    assert len(out) == len(edge_rows()) and out.columns.tolist() == ["doc_id", "lang_pred", "score", "known"]
    none = out[out.doc_id.isin([4, 5, 6])]
    assert (none.lang_pred == "und").all() and (none.score == 0).all()
    assert (out[out.doc_id.isin([1, 7, 14])].lang_pred == "en").all()
    empty = fit(no_docs, F.lit(True))
    assert (identify(docs, empty, ["doc_id"]).toPandas().lang_pred == "und").all()
    assert identify(no_docs, model, ["doc_id"]).count() == 0


def test_bloom_counts_are_corrected_membership():
    from outletlens.llm.langid import SLOTS, Model, _grams, _slots
    slots = np.zeros((SLOTS, 2), np.uint64)          # 65 languages: two words of bits
    _, _, h, _ = next(_grams(["water"]))
    for s in _slots(h):
        slots[s, 1] |= np.uint64(1)
    model = Model([f"l{i:02}" for i in range(65)], [1] * 65, slots)
    out = model.predict(["water water", "xyz", "12"])
    assert out.lang_pred.tolist() == ["l64", "l00", "und"] and out.score.tolist()[0] == 1


def test_language_id_is_the_same_alone_and_in_a_batch():
    from outletlens.llm.langid import SLOTS, Model, _grams, _slots
    texts = ["he", "hi he", "he", "", None, "1 hello", "he!", "é he", "he"]
    slots = np.zeros((SLOTS, 1), np.uint64)
    for i, word in enumerate(["he", "hi"]):
        _, _, h, _ = next(_grams([word]))
        for s in _slots(h):
            slots[s, 0] |= np.uint64(1 << i)
    model = Model(["a", "b"], [1, 1], slots)
    alone = pd.concat([model.predict([t]) for t in texts], ignore_index=True)
    pd.testing.assert_frame_equal(model.predict(texts), alone)
    assert alone.known.tolist()[0] == 1


def test_language_id_learns_copies_as_one_text(spark):
    from pyspark.sql import functions as F

    from outletlens.llm.langid import fit
    from tests.llm.conftest import prose
    single = [(prose(i, 12), "en") for i in range(200)] + [(prose(i, 12)[::-1], "xx") for i in range(50)]
    copies = single + [single[k] for k in (3, 7, 220) for _ in range(300)]
    a, b = (fit(spark.createDataFrame(rows, "text string, lang string").repartition(4), F.lit(True), train_texts=60) for rows in (single, copies))
    assert a.texts == b.texts == [200, 50]
    assert a.slots.any() and (a.slots == b.slots).all()


def _base(text):
    word = re.compile("[^\x20\x09-\x0D]+")
    w, seen, cover = word.findall(text or ""), defaultdict(list), set()
    for j in range(len(w) - 7):
        seen[tuple(w[j:j + 8])].append(j)
    for v in seen.values():
        if len(v) > 1:
            for j in v:
                cover.update(range(j, j + 8))
    lines = [x for x in (text or "").split("\n") if word.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n


def test_quality_rules_base_counts(spark, docs, no_docs):
    from outletlens.llm.quality_rules import quality_columns
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality_columns(docs).select("doc_id", "score", *cols, "kept").toPandas()
    assert (out.score == "clash").all()
    assert sorted(tuple(r) for r in out[cols].to_numpy().tolist()) == sorted(_base(t) for _, t, *_ in edge_rows())
    assert not out[out.base_failed].kept.any()
    assert quality_columns(no_docs).count() == 0


def test_quality_rules_lines(spark):
    from outletlens.llm.quality_rules import quality_columns
    good = "This is one plain sentence with enough words in it.\n" * 1 + "And here a second one follows with yet more words to read."
    rows = [("clean", good), ("few bad lines", good + "\nHome | News | About | Contact\nAll rights reserved."), ("shouted", "BUY!! THIS!! NOW!! " * 10),
            ("decorated", " ".join(f"word{i}###" for i in range(30))), ("blank lines", good + "\n\n \n")]
    out = {r["k"]: r for r in quality_columns(spark.createDataFrame(rows, "k string, text string")).collect()}
    assert [k for k, _ in rows if out[k]["kept"]] == ["clean", "few bad lines", "blank lines"]
    assert out["few bad lines"]["clean_text"] == good and out["blank lines"]["clean_text"] == good + "\n\n \n"


def test_quality_rules_plan_is_native(spark, docs):
    from outletlens.llm.quality_rules import quality_columns
    from outletlens.llm.url_filter import judge_urls
    pages = docs.selectExpr("doc_id AS page_id", "text AS url")
    for df in (quality_columns(docs), judge_urls(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_url_filter(spark, no_docs):
    from outletlens.llm.url_filter import judge_urls
    urls = ["https://A.Example.NET/en/1?x", "http://b.net", "http://b.net/", "https://x.example.com/de/5", "https://example.com/en/5#t", None,
            "no host/path", "ftp://sub.org/fr/a://b", "http://ÄB.org/FR/", "http://b.net?q=/", "http://notexample.net/en/", "http://b.net/"]
    urls += [f"http://shop.example.com/{'de' if i % 2 else 'en'}/{i}" for i in range(200)]
    out = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).toPandas().sort_values("page_id")
    assert out.host.tolist()[:10] == ["a.example.net", "b.net", "b.net", "x.example.com", "example.com", "", "", "sub.org", "Äb.org", "b.net"]
    assert out.path.tolist()[:9] == ["/en/1", "", "/", "/de/5", "/en/5", "", "", "/fr/a://b", "/FR/"]
    assert [None if pd.isna(r) else r for r in out.rule[:12]] == ["example.net/en/", None, "net/", "example.com/de/", None, None, None, "org/fr/", None, None, "net/", "net/"]
    shop = out[out.host == "shop.example.com"]
    assert (shop.verdict == np.where(shop.path.str.startswith("/de/"), "block", "allow")).all()
    assert set(shop.template) == {"/de/*", "/en/*"}
    assert judge_urls(no_docs.selectExpr("doc_id AS page_id", "text AS url")).count() == 0


def test_url_template_purity_rejects_unlabelled_pages(spark):
    from outletlens.llm.url_filter import judge_urls
    rules = [("block", "h.com", "/ads/1")]
    urls = [f"http://h.com/ads/{i}" for i in range(100, 200)] + [f"http://h.com/ads/{i}" for i in range(200, 220)] + [f"http://h.com/news/{i}" for i in range(100)]
    out = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).toPandas()
    assert (out[out.path.str.startswith("/ads/2")].verdict == "block").all() and out[out.path.str.startswith("/ads/2")].rule.isna().all()
    assert (out[out.path.str.startswith("/news/")].verdict == "allow").all()


def test_quality_classifier_held_out(spark):
    from outletlens.llm.queries import QUERIES
    out = QUERIES["op10_quality_classifier"](spark, SMALL).toPandas().set_index("doc_id")
    known = out.join(pd.read_parquet(f"{SMALL}/labels.parquet").set_index("doc_id"), how="inner")
    held = known[known.held_out]
    assert (held.predicted == held.quality).mean() >= 0.98
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad).mean() >= 0.99
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_quality_classifier_edges(spark, docs, no_docs):
    from pyspark.sql import functions as F

    from outletlens.llm.quality_model import score_quality
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 1, 0), (9, 1, 0), (12, 0, 0), (13, 0, 0), (14, 0, 0), (None, 1, 0), (8, None, 0), (999, 1, 0)], schema)
    out = score_quality(docs, labels, F.lit(True), ["doc_id", "score"]).toPandas()
    assert len(out) == len(edge_rows()) and out.score.notna().all()
    assert out[out.doc_id == 2].predicted.tolist() == [1, 1] and out[out.doc_id == 12].predicted.tolist() == [0]
    one = score_quality(docs, labels.where("quality = 1"), F.lit(True), ["doc_id"]).toPandas()
    assert (one.score == 1).all()
    none = score_quality(docs, labels.limit(0), F.lit(True), ["doc_id"]).toPandas()
    assert (none.score == 0.5).all()
    assert score_quality(no_docs, labels, F.lit(True), ["doc_id"]).count() == 0
