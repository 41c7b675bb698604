"""The pipeline over the rows that every operator has to stand, and over an empty table."""

import shutil

from conftest import SF
from fixtures import EDGE, edge, empty


def run(spark, docs, folder):
    import corpus_pipeline

    docs.write.parquet(f"{folder}/documents.parquet")
    shutil.copy(f"{SF}/benchmark.parquet", f"{folder}/benchmark.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows, _ = corpus_pipeline.common.materialise(stage(spark, rows, str(folder)), name)
        assert rows.columns == docs.columns, name
    return rows.collect(), corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_on_edge_rows(spark, tmp_path):
    kept, packed = run(spark, edge(spark), tmp_path)
    texts = {r.doc_id: r.text for r in kept}
    assert set(texts) <= {i for i, *_ in EDGE} and not {2, 3, 4, 5} & set(texts)  # no letters
    assert texts[6].startswith("passage0") and 12 not in texts  # the smallest id of equal texts stays
    assert all(r.f == "own" and r.score == "own" for r in kept)
    assert {r.doc_id for r in packed} == set(texts)
    sizes = {}
    for r in packed:
        sizes[r.sequence_id] = max(sizes.get(r.sequence_id, 0), r.offset + r.length)
    assert max(sizes.values()) <= 1024


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert run(spark, empty(spark), tmp_path) == ([], [])
