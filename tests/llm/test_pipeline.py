"""The pipeline: each stage's decisions against plain versions of them on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from ctxgraph.llm import decontam, pii, toxicity
from ctxgraph.session import cut

from .test_models import brute
from .test_neardup import brute as classes


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = cut(stage(spark, docs, sf), "test")
        if name != "tokens":
            assert docs.columns == columns
    rows = {k: {r.doc_id: r.text for r in v.collect()} for k, v in seen.items()}
    score = toxicity.score(seen["toxicity"], toxicity.fit(seen["toxicity"], spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    assert set(rows["near_duplicates"]) == {r.doc_id for r in score if r.toxicity < 0.5}
    kept = {i for i, (c, _) in classes(list(rows["near_duplicates"].items())).items() if i == c}
    assert set(rows["decontamination"]) == kept
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    clean = {i for i, t in rows["decontamination"].items() if not any(brute(t, x) >= decontam.THRESHOLD - 1e-9 for x in items.values())}
    assert set(rows["personal_data"]) == clean
    own = pii.Pseudonyms(pii.key_of(spark))
    assert rows["tokens"] == {i: own.text(t)[0] for i, t in rows["personal_data"].items()}
    last = docs.collect()
    assert {r.doc_id for r in last} == clean and all(r.round_trip for r in last)


def test_odd_rows(spark, sf, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns and an empty table."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    token = "abcDEF0123" * 60
    words = " ".join(f"plain{k}" for k in range(80))
    rows = [(9_001, None), (9_002, ""), (9_003, ""), (None, "no id at all"), (None, None), (9_004, words), (9_004, words), (9_005, words + " more"), (9_006, f"{item} and then some"), (9_007, f"token={token} and so on"), (9_008, " ".join(f"plain{k % 90 + 500}" for k in range(200_000)))]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["toxicity", "leaks", "pii_spans", "decoded", "token_ids", "class_id", "digest", "Toxicity_"]
    docs = base.unionByName(odd.select(*base.columns))
    for n, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(n))
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, sf), "test")
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name != "tokens":
            assert out.columns == before.columns and all(out.where(F.col(c) != n).isEmpty() for n, c in enumerate(names)), name
        docs = out
    kept = [r.doc_id for r in docs.where("doc_id > 9000 OR doc_id IS NULL").collect()]
    assert sorted(x or 0 for x in kept) == [0, 0, 9_001, 9_002, 9_004, 9_007, 9_008]
    assert docs.where("NOT round_trip").isEmpty()


def test_run_drops_what_it_wrote(spark, sf):
    import os

    from ctxgraph import session

    folder = session.scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-personal_data")
