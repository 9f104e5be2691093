"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A paragraph (a line) is hashed to a wide vector of 96 lanes. 32 lanes are hashes of its SHA-512 under
seeds of their own; the other 64 are a count sketch of its pairs of neighbouring words: each pair adds
or subtracts one in a lane of its own hash. A document's fingerprint is the sum over its paragraphs,
modulo 2**62 in the first lanes and 2**32 in the sketch. So the order of paragraphs doesn't matter, and
paragraphs are added or removed by adding or subtracting their vectors. The first lanes (1984 bits)
decide equality; the sketch, read as signed numbers, is a random projection of the word pairs, whose
cosine is the likeness. A text has fewer than 2**31 bytes, so no lane of its sketch runs over.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lanes that decide equality, and lanes of the sketch.
EXACT, SKETCH = 32, 64
LOW62, LOW32 = (1 << 62) - 1, (1 << 32) - 1
#: White space but the line feed, all taken for blanks.
BLANKS = "\t\x0b\x0c\r"
#: Tasks, and ranges of ids, for each shuffle partition, so that uneven ones even out.
TASKS, RANGES = 4, 8


def low(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask))


def bound(value: Column, function) -> Column:
    """``function`` of an array that is computed once, however often the function reads it."""
    return F.flatten(F.transform(F.array(value), function))


def exact_lanes(text: Column) -> Column:
    """Sums of the lanes of the lines' digests, in one pass over the lines."""
    digests = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 512))
    return F.aggregate(digests, F.array_repeat(F.lit(0).cast("long"), EXACT), lambda acc, d: F.transform(acc, lambda x, i: low(x + low(F.xxhash64(i, d), LOW62), LOW62)))


def pair_codes(text: Column) -> Column:
    """An odd number for each pair of neighbouring words of a line, the last word once more alone: 2 * (2 * lane + sign) + 1; past all lanes where no word is.

    Pieces between blanks are the words, so two blanks in a row part a pair.
    """

    def of_line(line: Column) -> Column:
        return bound(F.split(line, " "), lambda ws: F.transform(ws, lambda w, i: F.when(w == "", F.lit(4 * SKETCH + 1)).otherwise(F.xxhash64(w, F.get(ws, i + 1)).bitwiseAND(F.lit(4 * SKETCH - 1)).bitwiseOR(F.lit(1)).cast("int"))))

    return F.flatten(F.transform(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), "\n", -1), of_line))


def sketch_lanes(text: Column) -> Column:
    """Pairs of sign + less those of sign - for each lane: codes are sorted among marks, one for each code, and the marks' places tell the counts."""
    marked = F.concat(pair_codes(text), F.sequence(F.lit(0), F.lit(4 * SKETCH), F.lit(2)))
    places = F.filter(F.transform(F.sort_array(marked), lambda x, i: F.when(x.bitwiseAND(F.lit(1)) == 0, i)), lambda i: i.isNotNull())
    return bound(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda j: low((2 * F.get(p, 2 * j + 1) - F.get(p, 2 * j) - F.get(p, 2 * j + 2)).cast("long"), LOW32)))


def vector_of(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the fingerprint of the string column ``text`` as 96 longs."""
    return df.withColumn(out, F.concat(exact_lanes(F.col(text)), sketch_lanes(F.col(text))))


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of both multisets of paragraphs together, or with ``sign`` -1 of the first without the second."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + sign * y), lambda x, i: F.when(i < EXACT, low(x, LOW62)).otherwise(low(x, LOW32)))


def text_of(vector: Column) -> Column:
    """The fingerprint as a hexadecimal string."""
    return F.lower(F.array_join(F.transform(vector, lambda x, i: F.lpad(F.hex(x), F.when(i < EXACT, 16).otherwise(8), F.lit("0"))), ""))


def signed(vector: Column) -> Column:
    """The lanes of the sketch as signed numbers."""
    return F.transform(F.slice(vector, EXACT + 1, SKETCH), lambda x: F.when(x > LOW32 // 2, x - (LOW32 + 1)).otherwise(x).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, and 1 for equal fingerprints: the cosine of the sketches, no less than 0; 0 where one sketch is all zero."""

    def sums(pairs: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0.0).alias("xy"))
        add = lambda s, p: F.struct((s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"), (s["xy"] + p["x"] * p["y"]).alias("xy"))
        cosine = lambda s: F.when((s["xx"] == 0) | (s["yy"] == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s["xy"] / F.sqrt(s["xx"] * s["yy"]))))
        return F.aggregate(pairs, start, add, cosine)

    return F.when(a == b, 1.0).otherwise(sums(F.zip_with(signed(a), signed(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (string) of each row; null text counts as empty."""
    return vector_of(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "v").select("doc_id", text_of(F.col("v")).alias("fingerprint"))


def dealt(rows: DataFrame, ranges: int) -> DataFrame:
    """Deal ``rows`` (id, tie, text) over ranges of (id, tie), so that each row's next one by descending order is in its own range.

    Adds ``range`` and ``guest``. Ranges are cut at some of the rows' own keys, so the highest key of a
    range is known: its row is dealt to the range above as well, as a guest that comes after all others,
    and that of the highest key of all to the lowest range. Cuts come from about 64 rows a range, picked
    by a hash of the key whatever the table's size; only they reach the driver. ``tie`` is a hash of the text: so rows that share
    an id, or have none, are spread, too, unless their texts are equal as well.
    """
    keys = rows.select("id", "tie")
    top, n = keys.agg(F.max(F.struct("id", "tie")).alias("top"), F.count(F.lit(1)).alias("n")).first()
    share = F.lit(min(1 << 30, 64 * ranges * (1 << 30) // max(n, 1)))
    picked = keys.filter(F.pmod(F.xxhash64("id", "tie", F.lit(17)), F.lit(1 << 30)) < share).distinct().collect()
    found = sorted((r["id"], r["tie"]) for r in picked)
    cuts = sorted(({found[i * len(found) // ranges] for i in range(1, ranges)} if found else set()) | ({(top["id"], top["tie"])} if n else {(0, 0)}))
    step = int(len(cuts) ** 0.5) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    # as text, one literal of the plan however many they are
    as_json = lambda gs: json.dumps([[{"id": i, "tie": t} for i, t in g] for g in gs])
    table = F.from_json(F.lit(as_json(groups)), "array<array<struct<id: long, tie: long>>>")
    heads = F.flatten(F.from_json(F.lit(as_json([[g[-1]] for g in groups])), "array<array<struct<id: long, tie: long>>>"))
    below = lambda c: (c["id"] < F.col("id")) | ((c["id"] == F.col("id")) & (c["tie"] < F.col("tie")))
    rows = rows.withColumn("group", F.size(F.filter(heads, below)))
    rows = rows.withColumn("near", F.element_at(table, F.least(F.col("group") + 1, F.lit(len(groups)))))
    own = (F.col("group") * step + F.size(F.filter("near", below))).cast("int")
    is_cut = F.exists("near", lambda c: (c["id"] == F.col("id")) & (c["tie"] == F.col("tie")))
    rows = rows.withColumns({"own": own, "is_cut": is_cut}).drop("group", "near")
    above = F.when(F.col("is_cut"), F.when(F.col("own") + 1 == len(cuts), 0).otherwise(F.col("own") + 1))
    places = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest")), F.struct(above.alias("range"), F.lit(True).alias("guest")))
    return rows.withColumn("place", F.explode(F.filter(places, lambda p: p["range"].isNotNull()))).select("id", "tie", "text", "doc_id", "place.*")


def fingerprint_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text has its last half (rounded down) replaced by the beginning of the next document's
    text, by descending doc_id, of the same length or all of it. Rows of one id follow each other by a
    hash of their texts, then the texts; a null id is the lowest. A null text counts as empty; a single
    row is its own next; an empty table gives no rows; further columns are ignored.

    Texts are shuffled once, by ranges. All that follows stays in the range's partition: texts are
    hashed there, behind the shuffle, so that the work is spread even where the table is one row group.
    """
    spark = docs.sparkSession
    ranges = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("range").orderBy("guest", F.col("id").desc(), F.col("tie").desc(), F.col("text").desc())
    near = dealt(rows, ranges).repartition(TASKS * int(spark.conf.get("spark.sql.shuffle.partitions")), "range").select("doc_id", "range", "guest", "text", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("at"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    near = near.select("doc_id", "range", "guest", "at", "text", n.cast("long").alias("n_chars"), F.when(~F.col("guest"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))).alias("edited"))
    near = near.withColumn("edited_sha256", F.sha2("edited", 256))
    both = vector_of(vector_of(near, "text", "v"), "edited", "w").drop("text", "edited")
    both = both.withColumn("next_v", F.lead("v").over(Window.partitionBy("range").orderBy("at"))).filter("NOT guest")
    v, w = F.col("v"), F.col("w")
    return both.select("doc_id", "n_chars", "edited_sha256", text_of(v).alias("fingerprint"), text_of(w).alias("edited_fingerprint"), likeness(v, w).alias("near_edited"), likeness(v, F.col("next_v")).alias("near_next"))
