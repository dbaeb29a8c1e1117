import corpus_pipeline
from marlstone.llm import decontam, minhash, secrets


def test_stages_in_order_over_a_small_corpus(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "mixing"]
    before, kept = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, before, src).write.parquet(f"{tmp_path}/{k}")
        before = spark.read.parquet(f"{tmp_path}/{k}")
        assert before.dtypes == docs.dtypes, name
        kept.append({r.doc_id: r.text for r in before.collect()})
    n = docs.count()
    assert 0.6 * n < len(kept[0]) <= n
    # Each stage's decision against its operator on the stage's own input.
    q = spark.read.parquet(f"{tmp_path}/0")
    assert set(kept[1]) == {r.doc_id for r in minhash.near_duplicates(q).collect() if r.kept}
    m = spark.read.parquet(f"{tmp_path}/1")
    assert set(kept[2]) == set(kept[1]) - {r.doc_id for r in decontam.contaminated(m, spark.read.parquet(f"{src}/benchmark.parquet")).collect()}
    assert set(kept[3]) == set(kept[2])
    for i, t in kept[3].items():
        assert (t == kept[2][i]) == (not secrets.spans_of(kept[2][i]))
    total = corpus_pipeline.run(spark, src).collect()
    assert {r.doc_id for r in total} <= set(kept[3]) and all(r.taken == r["size"] * r.copies for r in total)
    assert all(r.text == kept[3][r.doc_id] for r in total) and total[0].asDict().keys() >= {*docs.columns, "copies"}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows):
    for name, frame in {
        "documents": spark.createDataFrame(rows, SCHEMA),
        "labels": spark.createDataFrame([(0, 1, 0), (1, 0, 0), (0, 1, 0), (None, None, None)], "doc_id long, quality long, toxic long"),
        "benchmark": spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "")], "item_id long, text string"),
    }.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_on_odd_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "none", [])).collect() == []
    good = "some good words that make a sentence which nobody else has written before now"
    rows = [(0, good, "en", "web", 5), (0, good, "en", "web", 5), (1, None, None, None, None), (2, "", "en", "web", 0), (None, "a row without id", "en", None, 3), (3, "long " * 60_000, "en", "web", 9), (4, "password = hV7kd92LqPz and more", "en", "api", 9)]
    got = corpus_pipeline.run(spark, write(spark, tmp_path / "odd", rows)).collect()
    texts = {r.doc_id: r.text for r in got}
    assert len(got) == len(texts) and texts[0] == good and all(r.copies >= 1 and r.taken == r["size"] * r.copies for r in got)
    assert "hV7kd92LqPz" not in "".join(texts.values()) and not {1, 2} & set(texts)
