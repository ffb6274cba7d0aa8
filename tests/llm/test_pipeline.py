"""The pipeline's stages against their parts."""


def test_stages(spark, sf_dir):
    import corpus_pipeline as cp
    from chronoweave.llm.common import crc_mod, written
    from chronoweave.llm.language_id import identify_language
    from chronoweave.llm.mixing import mix
    from chronoweave.llm.pieces import default_model, model
    from chronoweave.llm.quality import score_quality
    from test_texts import brute_components

    assert [n for n, _ in cp.STAGES] == ["language", "quality", "deduplicate", "mixture", "encode"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept, before = {}, {}
    for name, stage in cp.STAGES:
        before[name] = docs
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = docs
        if name != "encode":
            assert docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    judged = identify_language(before["language"], before["language"].where(crc_mod("doc_id", 4) != 2))
    assert ids(kept["language"]) == ids(judged.where("not rejected"))
    scored = score_quality(before["quality"], spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 3) != 1)
    assert ids(kept["quality"]) == ids(scored.where("score >= 0.5"))
    groups = brute_components([(r.doc_id, r.text) for r in before["deduplicate"].collect()])
    assert ids(kept["deduplicate"]) == sorted(i for i, (_, root) in groups.items() if i == root)
    copies = {r.doc_id: r.copies for r in mix(before["mixture"]).collect()}
    assert ids(kept["mixture"]) == sorted(i for i, n in copies.items() for _ in range(n))
    library = model(default_model()).library
    texts = {r.doc_id: r.text or "" for r in before["encode"].collect()}
    rows = kept["encode"].collect()
    assert sorted(r.doc_id for r in rows) == ids(before["encode"]) and all(r.ids == library.encode(texts[r.doc_id]) for r in rows)


def test_empty(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
