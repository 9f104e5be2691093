"""Results as text, Markdown and SRT columns, and their files.

``results`` have path, text, segments, last_end and language. The labels are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import duration, srt_time
from ..functions.files import basename, size_mb, stem
from ..functions.text import filled, strip

LANGUAGES = {"zh": "中文", "en": "英文", "ja": "日文", "ko": "韓文", "es": "西班牙文", "fr": "法文", "de": "德文", "it": "義大利文"}
MODES = {"conservative": "保守", "balanced": "平衡", "aggressive": "積極"}
SUFFIX = {"classic": ("_transcript.txt", "_segments.md"), "plain": (".txt", "_時間戳.md"), "smart": (".txt", "_逐字稿.md")}
CLASSIC_LABELS = {"title": "音檔轉錄結果", "file": "檔案", "language": "語言", "size": "大小", "segments": "片段", "unit": " 個", "duration": "時長"}
PLAIN_LABELS = {"mode": "模式", "mode_value": "多語言自動偵測 + 智慧重轉", "segments": "片段數"}
SMART_LABELS = {"file": "原始檔案", "language": "偵測語言", "segments": "片段數量", "mode": "轉錄模式", "retry": "智慧重轉", "on": "開啟", "off": "關閉", "duration": "總時長"}


def label(code: Column, labels: dict[str, str], fallback: bool = True) -> Column:
    """A code's label; without one the code itself, or null."""
    found = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[code]
    return F.coalesce(found, code) if fallback else found


def line(name: str, value: Column, end: str = "\n") -> Column:
    return F.concat(F.lit(f"**{name}**："), value, F.lit(end))


def spans(end: str) -> Column:
    """Each segment's times and stripped text."""
    return F.array_join(F.transform("segments", lambda s: F.concat(F.lit("**["), duration(s["start"]), F.lit(" → "), duration(s["end"]), F.lit("]**\n\n"), strip(filled(s["text"])), F.lit(end))), "")


def srt() -> Column:
    entry = lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(s["start"]), F.lit(" --> "), srt_time(s["end"]), F.lit("\n"), strip(filled(s["text"])), F.lit("\n\n"))
    return F.array_join(F.transform("segments", entry), "")


def md_classic(labels: dict[str, str] = CLASSIC_LABELS, languages: dict[str, str] = LANGUAGES) -> Column:
    n = F.size("segments")
    return F.concat(
        F.lit(f"# {labels['title']}\n\n"),
        line(labels["file"], basename(F.col("path"))),
        line(labels["language"], label(F.col("language"), languages)),
        line(labels["size"], F.format_string("%.2f MB", size_mb(F.col("length")))),
        line(labels["segments"], F.concat(n.cast("string"), F.lit(labels["unit"]))),
        line(labels["duration"], F.when(n > 0, duration(F.col("last_end"))).otherwise("N/A"), "\n\n"),
        F.lit("---\n\n"),
        spans("\n\n---\n\n"),
    )


def md_plain(labels: dict[str, str] = PLAIN_LABELS) -> Column:
    return F.concat(F.lit("# "), stem(F.col("path")), F.lit("\n\n"), line(labels["mode"], F.lit(labels["mode_value"])), line(labels["segments"], F.size("segments").cast("string"), "\n\n"), F.lit("---\n\n"), spans("\n\n"))


def md_smart(mode: str = "balanced", retry: bool = True, labels: dict[str, str] = SMART_LABELS) -> Column:
    n = F.size("segments")
    return F.concat(
        F.lit("# "),
        stem(F.col("path")),
        F.lit("\n\n"),
        line(labels["file"], basename(F.col("path"))),
        line(labels["language"], F.col("language")),
        line(labels["segments"], n.cast("string")),
        line(labels["mode"], F.lit(mode)),
        line(labels["retry"], F.lit(labels["on" if retry else "off"])),
        F.when(n > 0, line(labels["duration"], duration(F.col("last_end")))).otherwise(""),
        F.lit("\n---\n\n"),
        spans("\n\n"),
    )


def rendered(results: DataFrame, profile: str = "smart", kinds: tuple[str, ...] = ("txt", "srt", "md"), mode: str = "balanced", retry: bool = True) -> DataFrame:
    """One row an output file: path, name, body. ``kinds`` of txt, srt, md; srt is none of the earlier profiles'."""
    txt_end, md_end = SUFFIX[profile]
    md = {"classic": md_classic, "plain": md_plain, "smart": lambda: md_smart(mode, retry)}[profile]
    made = {"txt": (txt_end, filled(F.col("text"))), "srt": (".srt", srt()), "md": (md_end, md())}
    base = stem(F.col("path"))
    files = [F.struct(F.concat(base, F.lit(made[k][0])).alias("name"), made[k][1].alias("body")) for k in kinds if k != "srt" or profile == "smart"]
    return results.select("path", F.explode(F.array(*files)).alias("f")).select("path", "f.*")


def collisions(files: DataFrame) -> DataFrame:
    """Output names that several files share, with the path that a batch in path order would leave: the last."""
    named = files.select("path", stem(F.col("path")).alias("base"))
    return named.groupBy("base").agg(F.count(F.lit(1)).alias("files"), F.max("path").alias("wins")).filter("files > 1")


def write_files(output: DataFrame, folder: str) -> None:
    """Write each body under its name into ``folder``, in UTF-8, over what is there; from the executors, through Spark's file systems.

    Of names that collide the one of the last path is written.
    """
    last = output.groupBy("name").agg(F.max_by("body", "path").alias("body"))

    def write(rows: Iterator) -> None:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for r in rows:
            with fs.open_output_stream(f"{root}/{r['name']}") as f:
                f.write(r["body"].encode())

    last.foreachPartition(write)
