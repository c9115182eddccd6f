from collections import defaultdict

import pytest

import corpus_pipeline
from pairlift.llm import quality_classifier, quality_rules
from tests.llm.test_exact_dedup import SPACE
from tests.llm.test_minhash import brute as components_by_brute_force
from tests.llm.test_packing import check_bins, tokens
from tests.llm.test_quality import labelled


@pytest.fixture
def corpus(spark, make_docs, edge_pairs, tmp_path):
    texts, labels = labelled(160)
    good = [t for t, y in zip(texts, labels, strict=True) if y]
    copies = [t.replace(" ", "\n", 3) + "\t" for t in good[:20]] + [" ".join(t.split()[:-1]) for t in good[20:60]]
    pairs = [*edge_pairs, *enumerate(texts, 1000), *enumerate(copies, 5000)]
    make_docs(pairs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(labels, 1000)), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), pairs


def test_stages_against_brute_force(spark, corpus):
    sf_dir, pairs = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {(r["doc_id"], r["score"]) for r in quality_classifier.quality_scores(docs, model).collect()}
    assert len(good) > 100
    import pyarrow as pa

    texts = [t or "" for _, t in pairs]
    score = quality_classifier.scores(pa.array(texts), model)
    verdict = quality_rules.measures(pa.array(texts))["kept"]
    left = [p for p, s, v in zip(pairs, score, verdict, strict=True) if s >= 0.3 and v]
    best = defaultdict(list)
    for doc_id, text in left:
        best[SPACE.sub("", text)].append((-len(text), doc_id is None, doc_id, text))
    left = [min(rows)[2:] for rows in best.values()]
    roots = components_by_brute_force(left, 5, 80)
    left = [p for p, (doc_id, _, root) in zip(left, roots, strict=True) if doc_id == root]
    want = sorted((i, len(tokens(t))) for i, t in left)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    total = defaultdict(int)
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert sorted(total.items()) == want and 40 < len(want) < len(pairs)
    check_bins(rows, 4096)


def test_stages_keep_the_columns(spark, corpus):
    sf_dir, _ = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "exact_dedup", "minhash_near_dedup", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_empty_tables(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
