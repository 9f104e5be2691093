"""Which segments are unclear, and why."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

Rule = Callable[[Column], Column]

#: Rules on the stripped text; any of them gives one reason in all.
RULES: tuple[Rule, ...] = (X.has_kana_around_hanzi, X.has_repeated_character, X.has_stop_run, X.is_numeric_only, X.has_particle_before_hanzi)

LOW, SILENT, PACKED, ODD, MIXED, BRIEF = "信心度低", "可能是靜音", "壓縮比高", "文字模式異常", "中日混合不自然", "內容過短"


def any_rule(stripped: Column, rules: Sequence[Rule] = RULES) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | rule(stripped)
    return out


def metric(name: str, of: Column | None = None) -> Column:
    """A metric as the rules see it, of the row or of a struct; what is missing raises no suspicion."""
    return F.coalesce(F.col(name) if of is None else of[name], F.lit(1.0 if name == "compression_ratio" else 0.0))


def reason(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), F.format_string("(%.2f)", value))


def numeric_reasons(threshold: float) -> list[Column]:
    logprob, silence, ratio = metric("avg_logprob"), metric("no_speech_prob"), metric("compression_ratio")
    return [F.when(logprob < threshold, reason(LOW, logprob)), F.when(silence > 0.7, reason(SILENT, silence)), F.when(ratio > 2.5, reason(PACKED, ratio))]


def total(flags: Sequence[Column]) -> Column:
    out = F.lit(0)
    for flag in flags:
        out = out + flag.cast("int")
    return out


def findings_of_metrics(threshold: float, of: Column | None = None) -> list[Column]:
    return [metric("avg_logprob", of) < threshold, metric("no_speech_prob", of) > 0.7, metric("compression_ratio", of) > 2.5]


def findings_of_text(stripped: Column, rules: Sequence[Rule]) -> list[Column]:
    """Those that follow from the text alone."""
    return [any_rule(stripped, rules), X.mixes_kana_and_simplified(stripped)]


def brief(stripped: Column, of: Column | None = None) -> Column:
    return (F.length(stripped) < 3) & (metric("avg_logprob", of) < -0.5)


def findings(stripped: Column, threshold: float, rules: Sequence[Rule]) -> list[Column]:
    """The six findings in their fixed order, as booleans that are never null. Every bound is strict."""
    return [*findings_of_metrics(threshold), *findings_of_text(stripped, rules), brief(stripped)]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, by a generator of one row: the optimiser would copy a projection into each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def with_reasons(segments: DataFrame, threshold: float = -0.8, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``reasons``, all reasons against a segment in fixed order; none means clear."""
    logprob, silence, ratio = metric("avg_logprob"), metric("no_speech_prob"), metric("compression_ratio")
    labels = [reason(LOW, logprob), reason(SILENT, silence), reason(PACKED, ratio), F.lit(ODD), F.lit(MIXED), F.lit(BRIEF)]
    found = once(segments, __stripped=X.strip(X.filled(F.col("text"))))
    flags = findings(F.col("__stripped"), threshold, rules)
    return found.withColumn("reasons", F.array_compact(F.array(*[F.when(f, label) for f, label in zip(flags, labels, strict=True)]))).drop("__stripped")


def with_reason_count(segments: DataFrame, threshold: float = -0.8, rules: Sequence[Rule] = RULES, name: str = "n_reasons") -> DataFrame:
    """Add how many reasons there are, without their labels."""
    found = once(segments, __stripped=X.strip(X.filled(F.col("text"))))
    return once(found, **{name: total(findings(F.col("__stripped"), threshold, rules))}).drop("__stripped")
