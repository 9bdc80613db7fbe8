from kbspark.plans import queries


def test_documents_with_references_stay(spark, tmp_path):
    spark.createDataFrame([(1, "fixes #12 and PR 34"), (2, "plain text")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: set(r.refs.split()) for r in queries.f28(spark, str(tmp_path)).collect()}
    assert got == {1: {"#1", "#7", "#12", "#34"}, 2: {"#2", "#7"}}
