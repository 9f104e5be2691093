"""Second attempts at unclear segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import millis
from ..functions.text import filled, strip
from ..functions.values import let
from ..schema import METRICS
from .quality import RULES, brief, findings_of_metrics, findings_of_text, metric, total

MARGIN_MS = 500


def with_span(segments: DataFrame, margin_ms: int = MARGIN_MS) -> DataFrame:
    """Add from_ms and to_ms, the audio to try again: a margin on both sides, within [0, duration_ms]."""
    return segments.withColumns({"from_ms": F.greatest(F.lit(0).cast("long"), millis(F.col("start")) - margin_ms), "to_ms": F.least(F.col("duration_ms"), millis(F.col("end")) + margin_ms)})


def first_result(attempts: DataFrame) -> DataFrame:
    """``attempts`` (file_id, seq, attempt, segments) to candidates: the first segment of each, stripped; an attempt without one is no candidate."""
    one = attempts.select("file_id", "seq", "attempt", F.get("segments", F.lit(0)).alias("s")).filter("s IS NOT NULL")
    return one.select("file_id", "seq", "attempt", strip(filled(F.col("s.text"))).alias("text"), *[F.col(f"s.{m}").alias(m) for m in METRICS])


def best_pick(segments: DataFrame, candidates: DataFrame, threshold: float = -0.8, attempts: int = 3) -> DataFrame:
    """``best_try`` with the candidates in a relation (file_id, seq, attempt, text, metrics): those of a segment are gathered, then joined once."""
    tries = candidates.filter(F.col("attempt") < attempts).groupBy("file_id", "seq").agg(F.collect_list(F.struct("attempt", "text", *METRICS)).alias("__tries"))
    return best_try(segments.join(tries, ["file_id", "seq"], "left"), F.col("__tries"), threshold, attempts).drop("__tries")


def best_try(segments: DataFrame, tries: Column, threshold: float = -0.8, attempts: int = 3) -> DataFrame:
    """Put the best candidate in the place of each unclear segment, if one is better.

    ``tries`` is an array of a segment's candidates (attempt, text, metrics), or null. A candidate must
    score (avg_logprob) above the original and have fewer reasons against it; of those the highest
    score wins, of equals the earliest. Position and times stay. Adds ``attempt`` (null: the original
    stayed). All is decided within the row, so nothing is shuffled. Texts are judged only of candidates
    that may still win by their metrics, and not again where one is the original's.
    """
    score = lambda x: F.coalesce(x["avg_logprob"], F.lit(-999.0))
    old_score = F.coalesce("avg_logprob", F.lit(-999.0))

    def best(own: Column, of_text: Column, short: Column) -> Column:
        """``own``: the stripped text; ``of_text``: how many findings follow from it; ``short``: whether it has under three characters."""
        n = total([*findings_of_metrics(threshold), short & (metric("avg_logprob") < -0.5)]) + of_text
        likely = F.filter(tries, lambda x: (x["attempt"] < attempts) & (score(x) > old_score) & (total(findings_of_metrics(threshold, x)) < n))
        bare = F.transform(likely, lambda x: F.struct(x.alias("x"), strip(filled(x["text"])).alias("t")))

        def reasons(y: Column) -> Column:
            again = F.when(y["t"] == own, of_text).otherwise(total(findings_of_text(y["t"], RULES)))
            return total([*findings_of_metrics(threshold, y["x"]), brief(y["t"], y["x"])]) + again

        ranked = F.transform(F.filter(bare, lambda y: reasons(y) < n), lambda y: F.struct(score(y["x"]).alias("score"), (-y["x"]["attempt"]).alias("rank"), y["x"].alias("x")))
        return F.when(n > 0, F.array_max(ranked)["x"])

    judged = lambda own: F.struct(total(findings_of_text(own, RULES)).alias("k"), (F.length(own) < 3).alias("short"))
    found = let(strip(filled(F.col("text"))), lambda own: let(judged(own), lambda j: best(own, j["k"], j["short"])))
    out, new = segments.withColumn("__new", found), F.col("__new")
    values = {c: F.when(new.isNotNull(), new[c]).otherwise(F.col(c)) for c in ("text", *METRICS)}
    return out.withColumns({**values, "attempt": new["attempt"]}).drop("__new")
