"""Golden cases, and window forms against plain folds on random sequences."""

import random
import re

import pytest
from pyspark.sql import functions as F

from segmentary.functions import clock
from segmentary.functions import files as N
from segmentary.functions import text as X
from segmentary.operators import chunks as C
from segmentary.operators.collect import counters, language_of_last_chunk, results
from segmentary.operators.loops import truncate_loops, without_loop
from segmentary.operators.merge import merge_short
from segmentary.operators.quality import with_reasons
from segmentary.operators.repeats import removed, run_capped, seen_cut
from segmentary.operators.retry import best_pick, first_result, with_span
from segmentary.schema import SEGMENTS


def segments(spark, rows):
    """Rows of (file, seq, start, end, text[, logprob, silence, ratio])."""
    return spark.createDataFrame([(*r, *([None] * (8 - len(r)))) for r in rows], SEGMENTS)


def texts(spark, words, file=1):
    return segments(spark, [(file, i, float(i), i + 1.0, w) for i, w in enumerate(words)])


def kept(df):
    return [r["seq"] for r in df.orderBy("file_id", "seq").collect()]


def test_run_capped(spark):
    assert kept(run_capped(texts(spark, ["Hello", "hello!", "HELLO.", "hello", "a", "hello", "bye"]))) == [0, 1, 2, 5, 6]


def test_seen_cut(spark):
    assert kept(seen_cut(texts(spark, ["hello", "world", "hello", "world", "hello", "again"]))) == [0, 1, 2, 3]
    assert kept(seen_cut(texts(spark, ["hello", "hey", "hello", "world", "hello"]))) == [0, 2, 3, 4]


def fold_capped(rows, cap=2):
    out, last, n = [], None, 0
    for i, t in enumerate(rows):
        k = re.sub(r"[^\w]", "", t.lower())
        if len(k) < 2:
            n = 0
            continue
        n = n + 1 if k == last else 0
        if n > cap:
            continue
        last = k
        out.append(i)
    return out


def fold_seen(rows):
    out, seen, n = [], set(), 0
    for i, t in enumerate(rows):
        t = t.strip()
        if len(t) < 5:
            continue
        if t in seen:
            n += 1
            if n >= 3:
                break
        else:
            n = 0
            seen.add(t)
        out.append(i)
    return out


def fold_merge(rows):
    out = []
    for r in rows:
        if out and out[-1]["end"] - out[-1]["start"] < 2.0 and r["start"] - out[-1]["end"] <= 2:
            out[-1] = out[-1] | {"end": r["end"], "text": out[-1]["text"] + " " + r["text"]}
        else:
            out.append(dict(r))
    return [(r["start"], r["end"], r["text"]) for r in out]


def test_windows_equal_folds(spark):
    rng = random.Random(5)
    files = {f: [rng.choice(["hello", "hello ", "Hello!", "world", "again", "a", "", " x ", "longer"]) for _ in range(rng.randint(1, 25))] for f in range(120)}
    df = segments(spark, [(f, i, float(i), i + 1.0, t) for f, ts in files.items() for i, t in enumerate(ts)])
    for operator, fold in ((run_capped, fold_capped), (seen_cut, fold_seen)):
        found = {}
        for r in operator(df).collect():
            found.setdefault(r["file_id"], []).append(r["seq"])
        assert {f: sorted(v) for f, v in found.items()} == {f: e for f, ts in files.items() if (e := fold(ts))}


def test_merge_golden(spark):
    def run(rows):
        found = merge_short(segments(spark, [(1, i, *r) for i, r in enumerate(rows)])).orderBy("seq").collect()
        return [(r["start"], r["end"], r["text"]) for r in found]

    assert run([(0.0, 1.0, "a"), (1.0, 1.5, "b"), (1.5, 4.0, "c")]) == [(0.0, 4.0, "a b c")]
    assert run([(4.0, 4.5, "d"), (7.0, 8.0, "e")]) == [(4.0, 4.5, "d"), (7.0, 8.0, "e")]
    assert run([(0.0, 1.0, "a"), (3.0, 3.5, "b")]) == [(0.0, 3.5, "a b")]
    assert run([(0.0, 2.0, "a"), (2.0, 2.5, "b")]) == [(0.0, 2.0, "a"), (2.0, 2.5, "b")]


def test_merge_equals_fold(spark):
    rng, files = random.Random(6), {}
    for f in range(150):
        at, rows = 0.0, []
        for i in range(rng.randint(1, 20)):
            at += rng.choice([-1.0, 0.0, 0.0, 0.5, 2.0, 2.5])
            end = at + rng.choice([0.0, 0.25, 0.5, 1.0, 2.0, 3.0])
            rows.append({"start": at, "end": end, "text": f"w{i}"})
            at = end
        files[f] = rows
    found = {}
    for r in merge_short(segments(spark, [(f, i, r["start"], r["end"], r["text"]) for f, rows in files.items() for i, r in enumerate(rows)])).orderBy("file_id", "seq").collect():
        found.setdefault(r["file_id"], []).append((r["start"], r["end"], r["text"]))
    assert found == {f: fold_merge(rows) for f, rows in files.items()}


@pytest.mark.parametrize(
    ("text", "metrics", "count"),
    [
        ("clear text", (-0.8, 0.7, 2.5), 0),
        ("clear text", (-0.81, 0.71, 2.51), 3),
        ("彼は这个", (0.0, 0.0, 1.0), 2),
        ("彼は专做", (0.0, 0.0, 1.0), 0),
        ("aaaaa", (0.0, 0.0, 1.0), 1),
        ("aaaa", (0.0, 0.0, 1.0), 0),
        ("12, 3.5", (0.0, 0.0, 1.0), 1),
        ("。、。", (0.0, 0.0, 1.0), 1),
        ("ok", (-0.6, 0.0, 1.0), 1),
        ("", (0.0, 0.0, 1.0), 0),
        ("カ对", (0.0, 0.0, 1.0), 1),
        (None, (None, None, None), 0),
    ],
)
def test_reasons(spark, text, metrics, count):
    row = with_reasons(segments(spark, [(1, 0, 0.0, 1.0, text, *metrics)])).first()
    assert len(row["reasons"]) == count


def test_reason_order_and_labels(spark):
    row = with_reasons(segments(spark, [(1, 0, 0.0, 1.0, "ok", -1.5, 0.9, 3.0)])).first()
    assert row["reasons"] == ["信心度低(-1.50)", "可能是靜音(0.90)", "壓縮比高(3.00)", "內容過短"]


def values(spark, column, rows, kind):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column(F.col("x"))).collect()]


def test_times(spark):
    assert values(spark, clock.srt_time, [0.0, 3661.5, 1.001], "double") == ["00:00:00,000", "01:01:01,500", "00:00:01,000"]
    assert values(spark, clock.duration, [330.9, 90061.0, 172800.0, 0.0], "double") == ["0:05:30", "1 day, 1:01:01", "2 days, 0:00:00", "0:00:00"]


def test_text_functions(spark):
    odd = ["", " ", "　a b　", "\x1cx\x1f y\x85", "\n a\t", "一 二"]
    assert values(spark, X.strip, odd, "string") == [s.strip() for s in odd]
    assert values(spark, X.words, odd, "string") == [s.split() for s in odd]
    assert values(spark, X.normalised, ["Ab-c_1 é!", "。你好"], "string") == ["abc_1é", "你好"]
    assert values(spark, lambda c: X.occurrences(c, F.lit("aa")), ["aaaaa", "", "ba"], "string") == [2, 0, 0]


def test_names(spark):
    names = ["x.y.mp3", "a.mp3", ".mp3", "b.WAV", "noext", "a..mp3", ".a.mp3"]
    import os.path

    assert values(spark, N.extension, [f"/d.x/{n}" for n in names], "string") == [os.path.splitext(n)[1].lower() for n in names]
    assert values(spark, N.stem, [f"/d.x/{n}" for n in names], "string") == [os.path.splitext(n)[0] for n in names]
    assert values(spark, lambda c: N.route(c, 100.0), [100.0, 100.5], "double") == ["direct", "chunked"]
    assert values(spark, lambda c: N.route(F.lit(200.0), 100.0, c), [True, False], "boolean") == ["chunked", "direct"]


def plan(spark, f, ms):
    return [(r["start_ms"], r["end_ms"]) for r in f(spark.createDataFrame([(1, ms)], "file_id long, duration_ms long")).orderBy("chunk_no").collect()]


def test_chunk_plans(spark):
    assert plan(spark, C.overlapping_plan, 700_000) == [(0, 300_000), (298_000, 598_000), (596_000, 700_000)]
    assert plan(spark, C.overlapping_plan, 300_000) == [(0, 300_000)]
    assert plan(spark, C.fixed_plan, 1_300_000) == [(0, 600_000), (600_000, 1_200_000), (1_200_000, 1_300_000)]
    assert plan(spark, C.fixed_plan, 1_200_000) == [(0, 600_000), (600_000, 1_200_000)]
    assert plan(spark, C.fixed_plan, 0) == [(0, 0)]


def test_overlap_and_shift(spark):
    local = spark.createDataFrame([(1, c, s, s + 1) for c in (1, 2) for s in (0.0, 1.99, 2.0, 5.0)], "file_id long, chunk_no int, start double, end double")
    chunks = spark.createDataFrame([(1, 1, 0), (1, 2, 298_000)], "file_id long, chunk_no int, start_ms long")
    found = sorted((r["chunk_no"], r["start"]) for r in C.shift_by_start(C.overlap_drop(local), chunks).collect())
    assert found == [(1, 0.0), (1, 1.99), (1, 2.0), (1, 5.0), (2, 300.0), (2, 303.0)]
    lengths = spark.createDataFrame([(1, 1, 600_000), (1, 2, 600_000), (1, 3, 5)], "file_id long, chunk_no int, length_ms long")
    assert [r["offset_s"] for r in C.running_offset(lengths).orderBy("chunk_no").collect()] == [0.0, 600.0, 1200.0]


def test_best_pick(spark):
    original = segments(spark, [(1, 0, 0.0, 1.0, "some text", -1.0, 0.9, 1.0), (1, 1, 1.0, 2.0, "fine here", -0.1, 0.0, 1.0)])
    rows = [(1, 0, 0, "x one", -0.9, 0.9, 1.0), (1, 0, 1, "y two", -0.7, 0.9, 1.0), (1, 0, 2, "z three", -0.8, 0.0, 1.0), (1, 0, 3, "late", -0.1, 0.0, 1.0), (1, 1, 0, "no", -0.05, 0.0, 1.0)]
    tries = spark.createDataFrame(rows, "file_id long, seq int, attempt int, text string, avg_logprob double, no_speech_prob double, compression_ratio double")
    found = best_pick(original, tries).orderBy("seq").collect()
    assert [(r["text"], r["attempt"], r["start"]) for r in found] == [("y two", 1, 0.0), ("fine here", None, 1.0)]
    same = tries.filter("attempt IN (1, 2) AND seq = 0").withColumn("avg_logprob", F.lit(-0.7)).withColumn("no_speech_prob", F.lit(0.0))
    assert best_pick(original, same).filter("seq = 0").first()["attempt"] == 1


def test_retry_span_and_first_result(spark):
    row = with_span(spark.createDataFrame([(0.2, 3.0, 3200)], "start double, end double, duration_ms long")).first()
    assert (row["from_ms"], row["to_ms"]) == (0, 3200)
    kind = "array<struct<start: double, end: double, text: string, avg_logprob: double, no_speech_prob: double, compression_ratio: double>>"
    tries = spark.createDataFrame([(1, 0, 0, []), (1, 0, 1, [(0.0, 1.0, " a ", -0.1, 0.0, 1.0), (1.0, 2.0, "b", -0.2, 0.0, 1.0)])], f"file_id long, seq int, attempt int, segments {kind}")
    assert [(r["attempt"], r["text"]) for r in first_result(tries).collect()] == [(1, "a")]


def slow_loop(text):
    words = text.split()
    n = len(words)
    if n < 50:
        return text
    for w in (50, 45, 40, 35, 30, 25, 20, 15):
        if n < w * 3:
            continue
        i = n - w * 2
        while i > max(0, n - w * 10):
            if " ".join(words[i + w :]).count(" ".join(words[i : i + w])) >= 3:
                return " ".join(words[: i + w])
            i -= 1
    return text


def test_loops(spark):
    rng = random.Random(7)
    cases = ["a  b", " ".join(f"w{i}" for i in range(80)), None]
    for _ in range(60):
        block = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(10, 40))]
        cases.append("  ".join([f"u{i}" for i in range(rng.randint(0, 60))] + block * rng.randint(1, 12) + ["tail"] * rng.randint(0, 3)))
    expected = [None if c is None else slow_loop(c) for c in cases]
    assert [without_loop(c) for c in cases] == expected
    assert sum(c is not None and e != c for c, e in zip(cases, expected, strict=True)) > 20
    df = spark.createDataFrame(list(enumerate(cases)), "k int, text string")
    assert [r["text"] for r in truncate_loops(df).orderBy("k").collect()] == expected


def test_loops_by_any_white_space(spark):
    cases = [space.join([f"u{i}" for i in range(20)] + [f"w{i}" for i in range(20)] * 6) for space in ("\u3000", "\u00a0", "\u0085", "\x1c", "\x1d", "\x1e", "\x1f", "\u2003")]
    expected = [slow_loop(c) for c in cases]
    assert all(c != e for c, e in zip(cases, expected, strict=True))
    df = spark.createDataFrame(list(enumerate(cases)), "k int, text string")
    assert [r["text"] for r in truncate_loops(df).orderBy("k").collect()] == expected


def test_results(spark):
    df = segments(spark, [(1, 1, 1.0, 9.0, " b "), (1, 0, 0.0, 1.0, "a"), (1, 2, 2.0, 3.0, ""), (1, 3, 3.0, 4.0, None)])
    row, trimmed = results(df).first(), results(df, trim=True).first()
    assert (row["text"], row["n_segments"], row["last_end"]) == ("a  b ", 4, 4.0)
    assert trimmed["text"] == "a b  "
    assert [tuple(r) for r in removed(df, df.filter("seq > 1")).collect()] == [(1, 4, 2)]
    chunks = spark.createDataFrame([(1, 1, "en"), (1, 2, "ja"), (2, None, None)], "file_id long, chunk_no int, language string")
    assert {r["file_id"]: r["language"] for r in language_of_last_chunk(chunks).collect()} == {1: "ja", 2: "unknown"}
    assert tuple(counters(spark.createDataFrame([(True, 2), (False, 5)], "ok boolean, improved long")).first()) == (1, 1, 2)


def test_thousands(spark):
    from segmentary.functions.text import thousands

    row = spark.createDataFrame([(0, 999, 1234567, -1000)], "a long, b long, c long, d long").select(*[thousands(F.col(c)).alias(c) for c in "abcd"]).first()
    assert list(row) == ["0", "999", "1,234,567", "-1,000"]
