import os
from pathlib import Path

from segmentary.plans import profiles
from segmentary.plans.options import options_matrix, options_of_retry
from segmentary.schema import SEGMENTS
from segmentary.sinks import render
from segmentary.sources.audio import list_folder, scan_folder, totals
from segmentary.sources.recognizer import recognise


def test_scan(spark, tmp_path):
    for name in ("b.WAV", "a.mp3", "c.txt", ".mp3", "d.webm", "_e.mp3"):
        (tmp_path / name).write_bytes(b"xy")
    (tmp_path / "sub.mp3").mkdir()
    names = lambda df: [os.path.basename(r["path"]) for r in df.collect()]
    assert names(scan_folder(spark, str(tmp_path))) == ["a.mp3", "b.WAV", "d.webm"]
    assert names(list_folder(spark, str(tmp_path))) == ["_e.mp3", "a.mp3", "b.WAV", "d.webm", "sub.mp3"]
    assert totals(scan_folder(spark, str(tmp_path))).first()["files"] == 3


def found(spark, rows, path="/d/x.y.mp3"):
    segments = spark.createDataFrame([(1, i, *r, 0.0, 0.0, 1.0) for i, r in enumerate(rows)], SEGMENTS)
    files = spark.createDataFrame([(1, path, 3 << 19, "ja")], "file_id long, path string, length long, language string")
    from segmentary.operators.collect import results

    return profiles.with_files(results(segments), files)


def test_rendering(spark):
    df = found(spark, [(0.0, 1.5, " hi "), (1.5, 330.9, "there")])
    assert df.select(render.srt()).first()[0] == "1\n00:00:00,000 --> 00:00:01,500\nhi\n\n2\n00:00:01,500 --> 00:05:30,899\nthere\n\n"
    classic = df.select(render.md_classic()).first()[0]
    assert classic.startswith("# 音檔轉錄結果\n\n**檔案**：x.y.mp3\n**語言**：日文\n**大小**：1.50 MB\n**片段**：2 個\n**時長**：0:05:30\n\n---\n\n**[0:00:00 → 0:00:01]**\n\nhi\n\n---\n\n")
    assert df.select(render.md_plain()).first()[0].startswith("# x.y\n\n**模式**：")
    smart = df.select(render.md_smart(retry=False)).first()[0]
    assert "**智慧重轉**：關閉\n**總時長**：0:05:30\n\n---\n\n**[0:00:00" in smart


def test_rendering_without_segments(spark):
    df = found(spark, [])
    assert "**時長**：N/A\n\n---\n\n" in df.select(render.md_classic()).first()[0]
    assert "總時長" not in df.select(render.md_smart()).first()[0]
    assert df.select(render.srt()).first()[0] == ""


def test_files_and_collisions(spark, tmp_path):
    df = found(spark, [(0.0, 1.0, "é")]).unionByName(found(spark, [(0.0, 1.0, "later")], "/d/x.y.wav"))
    assert [tuple(r) for r in render.collisions(df).collect()] == [("x.y", 2, "/d/x.y.wav")]
    render.write_files(render.rendered(df), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["x.y.srt", "x.y.txt", "x.y_逐字稿.md"]
    assert (tmp_path / "out/x.y.txt").read_text(encoding="utf-8") == "later"


def test_options(spark):
    m = options_matrix(spark)
    assert m.count() == 16
    chosen = options_of_retry(m, "aggressive", 5).orderBy("retry").collect()
    assert [(r["mode"], r["attempt"], r["language"]) for r in chosen] == [("aggressive", 1, None), ("language", 0, "zh"), ("language", 0, "ja"), ("aggressive", 3, None), ("aggressive", 3, None)]


def test_recogniser_boundary(spark):
    chunks = spark.createDataFrame([(1, "/a.mp3", 1, 0, 9000)], "file_id long, path string, chunk_no int, start_ms long, end_ms long")
    row = recognise(chunks, options={"language": "ja"}).first()
    assert row["language"] == "ja" and [s["end"] for s in row["segments"]] == [4.0, 8.0, 9.0]


def test_profiles(spark):
    rows = [(1, i, float(i), i + 1.0, t, 0.0, 0.0, 1.0) for i, t in enumerate(["hello", "hello", "hello", "hello", "world again"])]
    df = spark.createDataFrame(rows, SEGMENTS)
    # the fourth repeat goes; 0 to 2 s, then what is left over the gap of one second, merge
    assert profiles.smart(df).first()["text"] == "hello hello hello world again"
    assert profiles.classic(df).first()["text"] == "hello hello hello"


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_rest_without_the_training_data_operators(tmp_path):
    """With the subpackage gone, and its pipeline module left or gone, the entry still lists the other queries."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 30 and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (tmp_path / "r" / name).unlink()
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
