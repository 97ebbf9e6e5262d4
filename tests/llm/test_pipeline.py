"""The pipeline's stages against plain versions of each."""

import corpus_pipeline
import numpy as np
from tests.compare import SF
from tests.llm.test_llm import brute_links, brute_sets, check_packs

from quillmill.llm import quality_rules, toxicity


def test_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good = {r["doc_id"] for r in quality_rules.quality_rules(documents).where("kept").collect()}
    assert kept[0].keys() == good
    first = spark.read.parquet(str(tmp_path / corpus_pipeline.STAGES[0][0]))
    model = toxicity.fit(*toxicity.sampled(first, spark.read.parquet(f"{SF}/labels.parquet")))
    assert kept[1].keys() == {d for d, t in kept[0].items() if model.score(t) < toxicity.THRESHOLD}
    ids = sorted(kept[1])
    parent = list(range(len(ids)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, j in brute_links(brute_sets([kept[1][d] for d in ids])):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert sorted(kept[2]) == [d for i, d in enumerate(ids) if root(i) == i]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packs(rows)
    assert {r["doc_id"] for r in rows} == kept[2].keys()
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in again) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows)


def test_stages_take_anything(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = " ".join(f"word{i}" for i in range(40))
    rows = [(None, base, None, None, 1), (1, None, None, None, None), (2, base, "en", "s", 1), (3, base, "en", "s", 1), (3, base, "en", "s", 1), (4, "", "en", None, 0)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= max(n, 0) * 2
    stay = corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted(str(r["doc_id"]) for r in stay) == ["1", "2", "4", "None"]
    assert np.all([r["text"] != "" or r["doc_id"] == 4 for r in stay])
