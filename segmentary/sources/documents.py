"""A stand-in for recognised speech: lines of documents as segments.

Times are sums of whole character counts over 16 and thus exact; every row whose (doc_id + seq) is a
multiple of 5 comes after a pause of 3 s. The metrics are synthetic test inputs, made from the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RATE, PAUSE = 16.0, 3.0


def synthetic_metrics(doc: Column, seq: Column, shift: Column | int = 0) -> dict[str, Column]:
    return {
        "avg_logprob": -((doc * 7 + seq * 13 + shift) % 160) / F.lit(100.0),
        "no_speech_prob": ((doc * 3 + seq * 11 + shift) % 100) / F.lit(100.0),
        "compression_ratio": F.lit(1.0) + ((doc * 5 + seq * 17 + shift) % 200) / F.lit(100.0),
    }


def segments_from_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to segments, one a line; seq counts from 0."""
    lines = docs.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    so_far = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("text")
    pause = F.when((F.col("file_id") + F.col("seq")) % 5 == 0, 1).otherwise(0)
    timed = lines.withColumns({"chars": F.sum(n).over(so_far), "pauses": F.sum(pause).over(so_far)})
    shift = F.col("pauses") * F.lit(PAUSE)
    return timed.select(
        "file_id",
        "seq",
        ((F.col("chars") - n) / F.lit(RATE) + shift).alias("start"),
        (F.col("chars") / F.lit(RATE) + shift).alias("end"),
        "text",
        *[c.alias(k) for k, c in synthetic_metrics(F.col("file_id"), F.col("seq")).items()],
    )


def candidates_from_segments(segments: DataFrame, attempts: int = 3) -> DataFrame:
    """Stand-in retries: the same formulas with 37 times the attempt added."""
    tried = segments.select("file_id", "seq", "text", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    metrics = synthetic_metrics(F.col("file_id"), F.col("seq"), (F.col("attempt") + 1) * 37)
    return tried.select("file_id", "seq", "attempt", F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"), *[c.alias(k) for k, c in metrics.items()])


def tries_of_segment(attempts: int = 3) -> Column:
    """The same candidates as an array in the segment's own row."""
    text = F.concat(F.lit(" "), "text", F.lit(" ")).alias("text")
    metrics = [[c.alias(k) for k, c in synthetic_metrics(F.col("file_id"), F.col("seq"), (a + 1) * 37).items()] for a in range(attempts)]
    return F.array(*[F.struct(F.lit(a).alias("attempt"), text, *m) for a, m in enumerate(metrics)])
