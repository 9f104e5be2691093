"""Fingerprints recomputed word by word, and on rows that share an id."""

import collections
import hashlib
import math
import random
import struct

import xxhash
from pyspark.sql import functions as F

from segmentary.llm import fingerprint as P


def spark_hash(*parts):
    """Spark's xxhash64 of strings and 32-bit integers; None is skipped."""
    seed = 42
    for x in parts:
        if x is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<i", x) if isinstance(x, int) else x.encode(), seed)
    return seed


def brute_vector(text):
    lanes = [0] * (P.EXACT + P.SKETCH)
    for line in text.split("\n"):
        digest = hashlib.sha512(line.encode()).hexdigest()
        for i in range(P.EXACT):
            lanes[i] = (lanes[i] + spark_hash(i, digest)) % 2**62
        words = line.translate(str.maketrans(P.BLANKS, " " * 4)).split(" ")
        for w, after in zip(words, [*words[1:], None], strict=True):
            if w:
                code = (spark_hash(w, after) & (4 * P.SKETCH - 1)) >> 1
                lanes[P.EXACT + code // 2] += 1 - 2 * (code % 2)
    return [x % 2**32 if k >= P.EXACT else x for k, x in enumerate(lanes)]


def brute_likeness(a, b):
    x, y = ([v - 2**32 if v >= 2**31 else v for v in z[P.EXACT :]] for z in (a, b))
    size = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return 1.0 if a == b else max(0.0, min(1.0, sum(p * q for p, q in zip(x, y, strict=True)) / size)) if size else 0.0


def as_text(v):
    return "".join(f"{x:016x}" if k < P.EXACT else f"{x:08x}" for k, x in enumerate(v))


def some_texts(n, seed=7):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "stone", "é🎉", "日本", "", "\t", "x\x0by", "\r"]) + rng.choice(["", "1", "2"])
    return ["\n".join(" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def test_against_brute_force(spark):
    texts = some_texts(60)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(500, None), (501, "one"), (502, "w " * 3000)]
    found = {r["doc_id"]: r for r in P.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), ranges=6).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        v, w, z, r = brute_vector(t), brute_vector(edited), brute_vector(after), found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (as_text(v), as_text(w))
        assert math.isclose(r["near_edited"], brute_likeness(v, w), abs_tol=1e-12) and math.isclose(r["near_next"], brute_likeness(v, z), abs_tol=1e-12)


def test_rows_of_one_id_are_spread(spark):
    """A third of the rows without an id, a third with one id: each still has its one next row."""
    texts = [f"text number {i}" for i in range(300)]
    rows = [(None if i % 3 == 0 else 9 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("tie"), "text", "doc_id")
    own = P.dealt(keyed, 40).filter("NOT guest")
    sizes = own.groupBy("id", "range").count().collect()
    assert max(r["count"] for r in sizes if r["id"] in (9, -(1 << 63))) < 40 and own.count() == 300
    assert collections.Counter(r["doc_id"] for r in P.fingerprint_edits(docs, ranges=40).collect()) == collections.Counter(i for i, _ in rows)


def test_lanes_wrap(spark):
    """Sums go over 2**62 without an error, and a removal undoes an insertion."""
    lines = "\n".join(f"line {i}" for i in range(400))
    rows = spark.createDataFrame([(lines, lines + "\nmore", "more")], "a string, b string, c string")
    for c in "abc":
        rows = P.vector_of(rows, c, f"v{c}")
    r = rows.select("va", P.added(F.col("vb"), F.col("vc"), -1).alias("back"), P.added(F.col("va"), F.col("vc")).alias("on"), "vb").first()
    assert r["va"] == r["back"] == brute_vector(lines) and r["on"] == r["vb"]
