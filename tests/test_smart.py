"""The smart profile over many rows: one shuffle, and the forms within a row equal those over relations."""

import random

from pyspark.sql import functions as F

from segmentary import queries
from segmentary.functions import text as X
from segmentary.operators.merge import merge_short, merged_by_file
from segmentary.operators.quality import with_reason_count
from segmentary.operators.retry import best_pick, best_try
from segmentary.plans import profiles
from segmentary.schema import METRICS, SEGMENTS
from segmentary.sources.documents import candidates_from_segments, segments_from_documents, tries_of_segment

TEXTS = ["some text", " ok", "", None, "aaaaab", "aaaa", "12, 3", "。、。", "彼は这个 ok", "カ对", "the same words", "The same, words!"]


def documents(spark, n=60):
    rng = random.Random(11)
    rows = [(k, "\n".join(t or "" for t in rng.choices(TEXTS, k=rng.randint(1, 12)))) for k in range(n)]
    return spark.createDataFrame([*rows, (n, ""), (n + 1, None), (None, "a text\nwithout id")], "doc_id long, text string")


def test_pipeline_smart_shuffles_once(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    for name, once in (("pipeline_smart", 1), ("retry_best_pick", 0)):  # the latter reads neither times nor texts, so nothing is left to shuffle
        plan = queries.REGISTRY[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert [plan.count(x) for x in ("Exchange ", "- Sort [", "Join", "FileScan")] == [once, once, 0, 1], name


def test_smart_by_row_equals_relation(spark):
    s = segments_from_documents(documents(spark))
    by_row, by_join = (sorted(profiles.smart(s, c).collect(), key=str) for c in (tries_of_segment(), candidates_from_segments(s)))
    assert by_row == by_join and len(by_row) > 50


def test_best_try_equals_plain_choice(spark):
    rng = random.Random(12)
    metrics = lambda: (rng.choice([None, -0.3, -0.6, -0.9, -1.2]), rng.choice([None, 0.1, 0.9]), rng.choice([None, 1.0, 2.6]))
    rows = [(1, i, float(i), i + 1.0, rng.choice(TEXTS), *metrics()) for i in range(250)]
    tries = [(1, i, a, rng.choice([rows[i][4], *TEXTS]), *metrics()) for i in range(250) for a in range(rng.randint(0, 5))]
    s = spark.createDataFrame(rows, SEGMENTS)
    c = spark.createDataFrame(tries, "file_id long, seq int, attempt int, text string, avg_logprob double, no_speech_prob double, compression_ratio double")
    count = {r["seq"]: r["n_reasons"] for r in with_reason_count(s).collect()}
    judged, score, expected = with_reason_count(c).collect(), lambda r: -999.0 if r["avg_logprob"] is None else r["avg_logprob"], {}
    for row in s.collect():
        good = [r for r in judged if r["seq"] == row["seq"] and r["attempt"] < 3 and count[row["seq"]] > 0 and score(r) > score(row) and r["n_reasons"] < count[row["seq"]]]
        best = min(good, key=lambda r: (-score(r), r["attempt"]), default=None)
        expected[row["seq"]] = (best["attempt"] if best else None, *((best or row)[f] for f in ("text", *METRICS)))
    nested = s.join(c.groupBy("file_id", "seq").agg(F.collect_list(F.struct("attempt", "text", *METRICS)).alias("tries")), ["file_id", "seq"], "left")
    for found in (best_pick(s, c), best_try(nested, F.col("tries"))):
        assert {r["seq"]: (r["attempt"], *(r[f] for f in ("text", *METRICS))) for r in found.collect()} == expected
    assert sum(e[0] is not None for e in expected.values()) > 30


def test_merged_by_file_equals_merge_short(spark):
    rng, rows = random.Random(13), []
    for f in range(80):
        at = 0.0
        for i in range(rng.randint(1, 25)):
            at += rng.choice([-1.0, 0.0, 0.0, 0.5, 2.0, 2.5])
            end = at + rng.choice([0.0, 0.25, 0.5, 1.0, 2.0, 3.0])
            rows.append((f, 3 * i, at, end, rng.choice(["a", "b c", "", None]), rng.choice([None, -0.5]), 0.1 * i, 1.0))
            at = end
    s = spark.createDataFrame(rows, SEGMENTS)
    by_file = merged_by_file(s).select("file_id", F.inline("segments"))
    assert sorted(by_file.collect(), key=str) == sorted(merge_short(s).collect(), key=str)


def test_rules_behind_their_guards(spark):
    plain = {
        X.has_repeated_character: r"(?d)(.)\1{4,}",
        X.has_kana_around_hanzi: "[ぁ-んァ-ン][们这那什么怎样][ぁ-んァ-ン]",
        X.has_stop_run: "[。、]{3,}",
        X.has_particle_before_hanzi: "[はがをにでと][们这那什]",
    }
    rng = random.Random(14)
    texts = [*TEXTS, "x\n\n\n\n\n", "éééééé", "𝒳" * 5, *("".join(rng.choices("あは这们对a。、é ", k=rng.randint(1, 9))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for rule, pattern in plain.items():
        assert [r[0] for r in df.select(rule(F.col("text"))).collect()] == [r[0] for r in df.select(F.col("text").rlike(pattern)).collect()], pattern
    mixed = F.col("text").rlike("[ぁ-ゖァ-ヶ]") & F.col("text").rlike("[这那里么们该让给对为]")
    assert df.filter(~(X.mixes_kana_and_simplified(F.col("text")).eqNullSafe(mixed))).count() == 0
