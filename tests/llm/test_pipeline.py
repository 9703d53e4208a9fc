import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_defaults(spark, odd_docs, no_docs, sf_dir):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= 0
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_long_clean_document_stays(spark, sf_dir):
    docs = spark.createDataFrame([(1, "\n".join(f"Wordle{i}" for i in range(100_001))), (2, "too short")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).collect()] == [1]


def test_run_equals_plain_version(spark, sf_dir):
    from test_model_operators import crc, ids_of
    from test_text_operators import brute_components, brute_lines
    from tokenizers import Tokenizer

    from sparquill.llm import packing, quality
    from sparquill.llm._tokens import default_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r["doc_id"] for r in quality.apply_policy(quality.ledger(docs)).where("kept").collect()}  # held to SQL elsewhere
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    gone = brute_lines(rows)
    kept = []
    for i, t in rows:
        lines = t.split("\n")
        mine = [x for k, x in enumerate(lines) if (i, k) not in gone]
        if len(mine) == len(lines) or any(x.split() for x in mine):
            kept.append((i, "\n".join(mine)))
    label = brute_components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if label[i] == i]
    low = lambda t: f" {' '.join((t or '').lower().split())} "
    items = [low(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not any(x in low(t) for x in items)]
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids_crc32"]))
    tokenizer = Tokenizer.from_file(default_path())
    want = {}
    for i, t in kept:
        ids = ids_of(tokenizer, t)
        want[i] = [(s, crc(ids[s : s + packing.SEQ_LEN])) for s in range(0, len(ids), packing.SEQ_LEN)]
    assert {i: sorted(v) for i, v in got.items()} == want
