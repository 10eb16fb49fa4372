"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline
from rasterloom.llm import quality_rules, suffix_dedup
from rasterloom.llm.common import written
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-dedup", "substring dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), "stage"))
        if name != "packing":
            assert seen[-1].columns == columns
    rows = [sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()) for d in seen[:-1]]
    start, clean, good, distinct, cut = rows
    assert set(clean) <= set(start) and set(good) <= set(clean) and set(distinct) <= set(good)
    # Few of the clean documents go with the toxic ones.
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len({i for i, _ in start} - {i for i, _ in clean} - toxic) < 0.15 * len(start)
    failed = {i for i, t in clean for n, *_, r in [brute.base_rules(t)] if n < 50 or 100 * r > 50 * n}
    assert {i for i, _ in good} == {i for i, _ in clean} - failed
    roots = brute.components([brute.fingerprint(t) for _, t in good])
    assert [d for d, r in zip(good, range(len(good))) if roots[r] == r] == distinct
    want = [(i, " ".join(w for w, g in zip(ws, gone) if not g) if any(gone) else t) for (i, t), (ws, gone) in zip(distinct, brute.removed(distinct))]
    assert cut == want
    assert {r.doc_id for r in seen[-1].select("doc_id").collect()} == {i for i, _ in cut}


ODD = ("_id", "_hash", "_judged", "_toxic", "_none", "own", "row", "kept", "kept_id", "kept_hash", "key_a", "judged_host", "host", "score", "range", "shard", "bucket", "h", "n", "w", "fp", "evidence")


def test_stages_take_odd_rows_and_any_column_names(spark, docs):
    """Nulls, empty and very long texts, repeated rows, and columns named as the operators name their own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD)
    rows = [(i, t, None, f"host{n % 3}" if n % 5 else None, len(t or ""), *[c if n % 2 else None for c in ODD]) for n, (i, t) in enumerate(docs)]
    for data in (rows, []):
        got = spark.createDataFrame(data, schema).repartition(2)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = written(stage(spark, got, SF), "stage")
            assert found.columns == got.columns, name
            if name != "substring dedup":
                assert set(found.collect()) <= set(got.collect()), name
            assert found.count() > len(data) // 4 or not data
            got = found
        packed = corpus_pipeline.STAGES[-1][1](spark, got, SF).collect()
        assert sum(r.length for r in packed if r.doc_id is None or r.doc_id >= -5) == sum(r.length for r in packed) and bool(packed) == bool(data)


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
    run = corpus_pipeline.run(spark, SF).collect()
    total = lambda rows: {i: sum(r.length for r in rows if r.doc_id == i) for i in {r.doc_id for r in rows}}
    assert total(run) == total(docs.collect()) and run


def test_decisions_do_not_need_a_doc_id(spark):
    rows = [(None, "short", "en", "a", 5), (None, " ".join(f"w{i}" for i in range(60)), "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.text[:2] for r in quality_rules.only_kept(docs).collect()] == ["w0"]
    assert suffix_dedup.without_repeats(docs).count() == 2
