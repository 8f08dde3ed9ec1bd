"""The pipeline's stages, each against what its operator decides on its own input."""

import corpus_pipeline
from gaugeworks.llm import decontaminate, line_dedup, quality_rules, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_decision_takes_effect(spark, docs):
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF).toPandas()
        before = {r.doc_id: r.text for r in now.collect()}
        if name == "quality_rules":
            assert set(out.doc_id) == {r.doc_id for r in quality_rules.judge(now).collect() if r.kept}
        elif name == "line_dedup":
            drop = {r.doc_id: set(r.dropped) for r in line_dedup.report(now).collect()}
            for key, text, n in zip(out.doc_id, out.text, out.n_chars, strict=True):
                left = [x for i, x in enumerate(before[key].split("\n")) if i not in drop[key]]
                assert text == "\n".join(left) and n == len(text)
        elif name == "near_duplicates":
            rows = simhash.near_duplicates(now, shingle=5).collect()
            assert sorted(out.doc_id) == sorted({r.component_id for r in rows})
        elif name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            items = decontaminate.Items([(r.item_id, r.text) for r in bench], 0.08, 24)
            assert set(out.doc_id) == {k for k, t in before.items() if not items.leaks(t)}
        else:
            assert set(out.doc_id) == set(before) and (out.groupby("sequence_id").length.sum() <= 1024).all()
            break
        assert list(out.columns) == COLUMNS
        kept[name] = len(out)
        now = spark.createDataFrame(out, docs.schema)
    assert kept["quality_rules"] < docs.count() and kept["decontamination"] < kept["near_duplicates"]
