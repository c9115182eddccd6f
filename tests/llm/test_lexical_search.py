import math
import random
import re
from collections import Counter

import pytest

from pairlift.llm import lexical_search
from tests.llm.conftest import EDGE_TEXTS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    for item, text in items:
        scores, asked = [], set(terms(text))
        for d, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked & c.keys())
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def key(r):
    return tuple((v is None, v) for v in r)


ITEM_TEXTS = [*EDGE_TEXTS, "ONE two-three, FOUR", "word1 word2 word3 äpfel1", "nothing like it", "the the the common", None, "…"]


@pytest.fixture(scope="module")
def corpus(edge_pairs):
    """Edge texts, and many documents of which a common word is in all and others are rare; copies tie."""
    rng = random.Random(8)
    docs = list(edge_pairs)
    for i in range(300):
        words = ["common", *(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(40)))]
        docs.append((100 + i, " ".join(words)))
    docs += [(1000 - i, "common w1 w2 w3") for i in range(60)]
    items = list(enumerate([*ITEM_TEXTS, "w1 w2 w3", " ".join(f"W{i}" for i in range(1, 60)), "common", "w1, w1; w7"]))
    return docs, [*items, (None, "w2 w5"), items[-1]]


def items_table(spark, items):
    rows = [(i, t, "x", None) for i, t in items]
    return spark.createDataFrame(rows, "item_id long, text string, UID string, bundle int").repartition(2)


@pytest.mark.parametrize(
    ("settings", "parts"),
    # The last has slices of a few documents: hardly any has ten of them, and none may lose one that counts.
    [({}, 5), ({"owners": 1, "term_bytes": 60_000, "k": 3}, 5), ({"owners": 5, "bundle_items": 9}, 60)],
)
def test_against_brute_force(spark, make_docs, corpus, settings, parts):
    docs, items = corpus
    got = lexical_search.search(make_docs(docs, parts), items_table(spark, items), **settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items, settings.get("k", 10)), key=key)


def test_accumulators_are_dropped_only_when_they_cannot_win():
    """Owners cut the vocabulary by frequency: rare terms first, like volumes of postings."""
    import numpy as np

    df = np.array([1, 1, 2, 3, 900, 1000, 40, 50, 0])
    owner = lexical_search.owners_of(df, 3)
    assert list(owner[np.argsort(df, kind="stable")]) == sorted(owner)
    assert owner.min() == 0 and owner.max() <= 2


def test_empty_tables(spark, make_docs):
    items = items_table(spark, [(1, "a b"), (2, None)])
    assert lexical_search.search(make_docs([]), items).collect() == []
    assert lexical_search.search(make_docs([(1, None), (2, " - ")]), items).collect() == []
    assert lexical_search.search(make_docs([(1, "a b")]), items.limit(0)).collect() == []
    assert lexical_search.search(make_docs([(1, "a b")]), items_table(spark, [(2, None), (3, "!")])).collect() == []


def test_terms_with_sql(spark, make_docs, corpus):
    """The registered SQL gives the same rows on edge cases."""
    import duckdb

    from pairlift.llm.queries import ORACLES

    docs, items = corpus
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = con.sql(ORACLES["op12_lexical_search"]).fetchall()
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)
