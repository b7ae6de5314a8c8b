import corpus_pipeline
from corvane.llm import queries


def test_stages_compose(spark, tmp_path):
    """The run is its stages, each over all its predecessor kept, against plain versions of the filters."""
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    texts = {i: words(f"w{i}_", 40) for i in range(40)}
    texts |= {100: words("c", 60), 101: words("c", 59) + " other", 102: words("c", 60) + "\nnew line here", 103: words("c", 60) + "\n\n"}
    texts |= {i: f"vile foul {words(f't{i}_', 10)}" for i in range(200, 260)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sizes = queries.table(spark, str(tmp_path), "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 3:
            assert docs.columns == corpus_pipeline.COLUMNS, name
            sizes.append(sorted(r.doc_id for r in docs.collect()))
    clean = sorted([*range(40), 100, 101, 102, 300, 301])
    assert sizes[0] == sorted([*clean, 103]) and sizes[1] == clean  # 103 is nothing but a copy
    assert sizes[2] == [i for i in clean if i != 101]
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out1")).filter("doc_id = 102").collect()} == {"new line here"}
    want = sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.drop("sequence_id", "offset").collect())) == want
