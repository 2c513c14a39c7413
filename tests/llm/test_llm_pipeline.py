"""The pipeline against plain Python, stage by stage, and the guard around the optional package."""

import re
from collections import Counter

import corpus_pipeline
from cohortlens.llm import mixing, packing
from tests.llm.test_llm_mixing import slow_mix
from tests.llm.test_llm_quality import check as judge_all
from tests.llm.test_llm_simhash import slow_components, slow_fingerprint


def rows_of(df):
    return Counter(str(r) for r in df.collect())


def test_stages_on_documents(spark, documents, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "source_mix", "best_fit_packing"]
    docs, wanted = documents, {r.doc_id: r for r in documents.collect()}
    kept = {r[0] for r in judge_all(documents) if r[7]}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        docs = after[name] = spark.read.parquet(str(tmp_path / name))
    assert rows_of(after["quality_rules"]) == Counter(str(wanted[k]) for k in kept)
    marks = [(k, slow_fingerprint(wanted[k].text)) for k in sorted(kept)]
    single = set(slow_components(marks))
    assert rows_of(after["near_dedup"]) == Counter(str(wanted[k]) for k in single)
    _, _, copies = slow_mix([(k, wanted[k].source, wanted[k].text) for k in sorted(single)])
    often = {k: copies[wanted[k].source, k, wanted[k].text][0] for k in single}
    assert rows_of(after["source_mix"]) == Counter({str(wanted[k]): n for k, n in often.items() if n})
    pieces = Counter()
    for k, n in often.items():
        size = len(re.findall(r"[^\x20\x09-\x0D]+", wanted[k].text))
        for start in range(0, size, packing.CAPACITY):
            pieces[k, start, min(packing.CAPACITY, size - start)] += n
    found = after["best_fit_packing"].collect()
    assert Counter((r.doc_id, r.start, r.size) for r in found) == +pieces
    whole = rows_of(corpus_pipeline.run(spark, "/root/testdata/sf0.001").drop("bin", "offset"))
    assert whole == rows_of(after["best_fit_packing"].drop("bin", "offset"))
    assert mixing.MOST_REPEATS == 3


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for label, start in (("odd", odd), ("empty", empty)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / label / name))
            docs = spark.read.parquet(str(tmp_path / label / name))
            if name != "best_fit_packing":
                assert docs.columns == start.columns


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(bool(re.match(rf"op{n}_", name)) for name in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
