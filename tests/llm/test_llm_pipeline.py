import corpus_pipeline
from starloom.llm import packing, quality, queries, secrets
from test_llm_jaccard import brute

SMALL = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {n for n in names if n.startswith("op")} >= set(queries.QUERIES) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= names


def test_stages_work_on_all_that_is_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").persist()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SMALL).persist()
    verdict = {r.doc_id for r in quality.judge(quality.with_counts(docs).persist()).where("__q_kept").select("doc_id").collect()}
    assert {r.doc_id for r in kept.collect()} == verdict and kept.columns == docs.columns
    lined = stages["line_dedup"](spark, kept, SMALL).persist()
    assert lined.columns == docs.columns and lined.count() == kept.count()
    assert lined.where("n_chars <> length(text)").isEmpty()
    single = stages["ngram_jaccard"](spark, lined, SMALL).persist()
    groups = brute([(r.doc_id, r.text) for r in lined.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, (_, c) in groups.items() if d == c)
    clean = stages["secret_scan"](spark, single, SMALL).persist()
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert secrets.find_secrets(clean).where("size(spans) > 0").isEmpty()
    packed = stages["best_fit_packing"](spark, clean, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in clean.collect()}
    assert packed.schema == packing.pack_documents(clean, queries.tokenizer_path("word_bpe_49k.json")).schema


def test_nulls_repeats_extra_columns_and_empty(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", None, 3, "x"), (1, text, "en", None, 3, "x"), (2, None, None, "s", None, "y"), (None, text + " tail", "en", "s", 3, None),
            (3, "", "en", "s", 0, "z"), (4, text + " password = abcdefghijklmnop", "en", "s", 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __hash string")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SMALL).persist()
        assert "__hash" not in df.columns or {r["__hash"] for r in df.collect()} <= {"x", "z", None}
        assert stage(spark, df.limit(0), SMALL).count() == 0 if "text" in df.columns else True
    assert {r.doc_id for r in df.collect()} <= {1, 4, None}


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 50 and "sequence_id" in out.columns
