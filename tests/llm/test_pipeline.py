from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute, data


def test_pipeline_on_a_small_table(spark, tmp_path):
    rows = data.rows()
    items = [(1, rows[6][1]), (2, "none of this")]
    data.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {d: t for d, t in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            left = {d: t for d, t in left.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            groups = brute.groups([(d, brute.fingerprint(t)) for d, t in left.items()])
            left = {d: t for d, t in left.items() if groups[d] == d}
        elif name == "decontamination":
            left = {d: t for d, t in left.items() if not brute.contamination(t, items)[4]}
        else:
            assert set(got) == set(left)
            assert all(brute.secrets(t)[4] == "" for t in got.values())
            left = got
        assert got == left, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed.collect()) == brute.pieces(list(left.items()))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first()[0] == sum(p[3] for p in brute.pieces(list(left.items())))
