"""What the recogniser is told: thresholds by mode and attempt, as a small relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "mode string, attempt int, language string, temperature array<double>, no_speech double, logprob double, compression double, beam int, best_of int, prompt string"
#: Attempt 0 of each mode, and how attempts 1 and 2 move from it; written out, as decimal sums in doubles aren't exact.
BASE = {
    "conservative": ((0.6, -0.8, 2.2), (0.5, -1.0, 2.4), (0.4, -1.3, 2.6)),
    "balanced": ((0.5, -1.0, 2.4), (0.4, -1.2, 2.6), (0.3, -1.5, 2.8)),
    "aggressive": ((0.3, -1.5, 2.8), (0.2, -1.7, 3.0), (0.1, -2.0, 3.2)),
}
TEMPERATURES = ([0.0], [0.2], [0.0, 0.2, 0.4], [0.0, 0.2, 0.4, 0.6])
LAST = (0.2, -2.0, 3.0)
CLASSIC = (None, [0.0, 0.2, 0.4, 0.6, 0.8], 0.6, -1.0, 2.4)
PROMPTS = {"zh": "這是中文對話。會議討論內容。繁體中文。", "ja": "これは日本語の会話です。会議の内容です。", "en": "This is English conversation. Meeting discussion."}


def options_matrix(spark: SparkSession) -> DataFrame:
    rows = [("classic", 0, *CLASSIC, None, None, None)]
    for mode, steps in BASE.items():
        for attempt, (silence, logprob, ratio) in enumerate((*steps, LAST)):
            beam = 5 if attempt > 1 else None
            rows.append((mode, attempt, None, TEMPERATURES[attempt], silence, logprob, ratio, beam, beam, None))
    rows += [("language", 0, lang, [0.0], 0.3, -1.5, 2.8, None, None, prompt) for lang, prompt in PROMPTS.items()]
    return spark.createDataFrame(rows, COLUMNS)


def options_of_retry(matrix: DataFrame, mode: str, attempts: int) -> DataFrame:
    """Options of retry 0, 1, ...: those of attempt 1, then Chinese, then Japanese, then attempt 3 for all further ones."""
    tries = matrix.sparkSession.range(attempts).select(F.col("id").cast("int").alias("retry"))
    wanted = F.when(F.col("retry").isin(1, 2), "language").otherwise(mode)
    number = F.when(F.col("retry") == 0, 1).when(F.col("retry") < 3, 0).otherwise(3)
    language = F.when(F.col("retry") == 1, "zh").when(F.col("retry") == 2, "ja")
    keyed = tries.select("retry", wanted.alias("mode"), number.alias("attempt"), language.alias("wanted"))
    found = keyed.join(F.broadcast(matrix), ["mode", "attempt"]).filter(F.col("wanted").eqNullSafe(F.col("language")))
    return found.drop("wanted")
