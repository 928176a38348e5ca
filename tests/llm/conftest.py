import random

import pytest

pytest.importorskip("outletlens.llm")

_SYLLABLES = ["the", "and", "tion", "er", "on", "wh", "ble", "ing", "ea", "re", "st", "ou"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


def edge_rows():
    """Null and empty texts, a null id, repeated rows, near copies, a shared passage, a very long text."""
    a, passage = prose(1, 120), prose(2, 90)
    near = a.split()
    near[60] = "changed"
    rows = [(1, a), (2, a), (2, a), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "One two"), (None, prose(3, 40)),
            (8, prose(4, 30) + "\n" + passage + "\n" + prose(5, 30)), (9, prose(6, 200) + " " + passage), (10, "é漢字 " * 300),
            ((1 << 62) + 11, prose(7, 60_000)), (12, "same line\n" * 100), (None, None), (13, "ab" * 2000), (14, "\x00 \x1c nul ▁ \U0001F600")]
    return [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """edge_rows with extra columns whose names the operators also use."""
    from pyspark.sql import functions as F
    out = spark.createDataFrame(edge_rows(), DOCS)
    for c in ("score", "kept", "node", "sketch", "words", "slice", "place", "length", "tkey", "spans", "lot", "bucket", "stats", "n", "rank"):
        out = out.withColumn(c, F.lit("clash"))
    return out.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
