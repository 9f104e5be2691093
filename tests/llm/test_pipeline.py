"""The pipeline's stages one after the other against brute-force versions of what they keep."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from segmentary.llm._common import materialize, table

    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(spark, steps):
    from test_llm import brute_components, check_sequences

    from segmentary.llm import language_id, toxicity
    from segmentary.llm._common import table

    columns = table(spark, SF, "documents").columns
    for name, before, after in steps[:-1]:
        assert after.columns == columns and 0 < after.count() <= before.count(), name
        assert after.exceptAll(before).count() == 0
    before = steps[0][1]
    model = language_id.train(before)
    assert {r["doc_id"] for r in steps[0][2].collect()} == {r["doc_id"] for r in before.collect() if (j := model.judge(r["text"] or ""))[0] != "und" and j[2] < 8}
    before = steps[1][1]
    model = toxicity.train(before, table(spark, SF, "labels"))
    assert {r["doc_id"] for r in steps[1][2].collect()} == {r["doc_id"] for r in before.collect() if model.score(r["text"] or "") < 0.5}
    rows = [(r["doc_id"], r["text"]) for r in steps[2][1].collect()]
    best = {}
    for i, t in rows:
        key = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        best[key] = max(best.get(key, i), i)
    assert sorted(r["doc_id"] for r in steps[2][2].collect()) == sorted(best.values())
    rows = [(r["doc_id"], r["text"]) for r in steps[3][1].collect()]
    assert sorted(r["doc_id"] for r in steps[3][2].collect()) == [i for i, _, _, kept in brute_components(rows, 5, 80, 100) if kept]
    packed = steps[4][2].collect()
    check_sequences(packed)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in steps[4][1].collect()}


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({c: F.lit(c) for c in ("kept", "row", "digest", "keep_id", "component_id", "gone")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert {"kept", "row", "digest"} <= set(docs.columns) and docs.first()["kept"] == "kept"


def test_near_copies_of_a_large_family(spark):
    from test_llm import brute_components, large_family

    rows = large_family(700)
    found = corpus_pipeline.no_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r["doc_id"] for r in found.collect()) == [i for i, _, _, kept in brute_components(rows, 5, 80, 100) if kept]


def test_empty_null_and_repeated_rows(spark, tmp_path):
    """Null and empty texts go with the languages, repeated rows leave one, a null id stays an id."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    one, other = "Hello the world, you and I are here in the house. " * 5, "The river and the sea are in the house of the world. " * 5
    rows = [(1, one, "en", "s", 0), (1, one, "en", "s", 0), (2, None, "en", "s", 0), (3, "", None, "s", 0), (None, other, "en", None, 0), (None, other, "en", None, 0), (5, "word of the house " * 3000, "en", "s", 0)]
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for docs, kept in (([], []), (rows, [1, 5, None])):
        spark.createDataFrame(docs, kind).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        found = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert sorted({r["doc_id"] for r in found}, key=str) == kept and sum(r["piece"] == 0 for r in found) == len(kept)
