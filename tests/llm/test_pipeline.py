"""The pipeline's stages one after another on the small tables."""

from collections import Counter

import corpus_pipeline
from annoflux.llm import toxicity
from tests.llm.test_dedup import expected_components, pairs_of
from tests.llm.test_text import personal


def test_stages(spark, corpus, sf_dir, tmp_path):
    assert len(corpus_pipeline.STAGES) == 5
    before, columns = corpus, corpus.columns
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / str(n)))
        after = spark.read.parquet(str(tmp_path / str(n)))
        kept.append((before, after))
        if n < 4:
            assert after.columns == columns
        before = after
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())

    a, b = kept[0]
    scored = toxicity.score(a, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(b) == Counter(r.doc_id for r in scored.where("predicted = 0").collect())
    a, b = kept[1]
    assert ids(b) == Counter(i for i, n, c in expected_components(pairs_of(a)).elements() if i == c or not n)
    a, b = kept[2]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert ids(b) == Counter(r.doc_id for r in a.collect() if not any(t in r.text for t in items))
    a, b = kept[3]
    assert ids(a) == ids(b)
    assert all(not personal(r.text)[4] for r in b.collect())
    clean = {r.doc_id: r.text for r in b.collect()}
    assert all(clean[r.doc_id] == r.text for r in a.collect() if not personal(r.text)[4])
    a, b = kept[4]
    assert ids(a) == ids(b)
    assert all(r.round_trip and r.decoded == r.text for r in b.collect())


def test_run_is_the_stages(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 0
    assert "n_tokens" in found.columns


def test_stages_on_hard_rows(spark, docs, none, sf_dir):
    """Nulls, empty and repeated rows and clashing columns pass every stage; so does an empty table."""
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        rows = {(r.doc_id, r.text) for r in after.collect()}
        assert {(None, None), (6, None), (7, ""), (8, " \t\n ")} <= rows, name
        assert stage(spark, none, sf_dir).count() == 0
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir)
    assert last.count() == docs.count()


def test_run_on_an_empty_table(spark, corpus, sf_dir, tmp_path):
    corpus.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
