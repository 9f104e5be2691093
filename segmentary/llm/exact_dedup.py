"""Exact deduplication by salted combining.

Rows are grouped on (digest, full text) at every stage, so texts are only ever called equal after
their whole content was compared:

1. local: the map side of the first aggregation keeps one row for each text of a task;
2. salted: groups of (digest, salt, text) are merged; a text that a third of all rows share is
   spread over ``salts`` reducers;
3. global: the at most ``salts`` winners of each text are combined.

Membership then goes back to the rows by digest alone, which is narrow. That is exact as stage 3 has
shown that a digest has one text; should two texts ever share a digest the query stops with an error
instead of merging them. The groups are written to the shared folder first: so both sides of that join
are plain, adaptive execution can split a hot digest's rows, and a lost executor doesn't bring the
text shuffles back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lower_ascii, materialize, sent_to_all

SALTS = 16
#: Letters of each part of a text that ``outline`` reads.
PART = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normal(text: str = "text") -> Column:
    """The text as it is compared."""
    return lower_ascii(F.coalesce(F.col(text), F.lit("")))


def text_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` (doc_id, text) to one row a digest: digest, keep_id, group_size."""
    rows = docs.select(F.col("doc_id").alias("id"), normal().alias("norm")).withColumn("digest", digest(F.col("norm")))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    )
    whole = salted.groupBy("digest", "norm").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    one = whole.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    clash = F.raise_error(F.concat(F.lit("different texts share the digest "), F.hex("digest"))).cast("long")
    return materialize(one.select("digest", F.col("keep").alias("keep_id"), F.when(F.col("texts") > 1, clash).otherwise(F.col("n")).alias("group_size")))


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest doc_id stays.
    Null text counts as empty, and all empty texts are equal. A null doc_id loses against any other;
    where all ids of a group are null, all its rows are kept. Rows repeated under one id share its
    fate. An empty table gives an empty result; further columns are ignored.
    """
    groups = text_groups(docs, salts, digest)
    sha = [] if digest is sha256 else [F.sha2(normal(), 256).alias("sha")]
    joined = docs.select("doc_id", digest(normal()).alias("digest"), *sha).join(groups, "digest")
    text_sha = F.col("sha") if sha else F.lower(F.hex("digest"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), text_sha.alias("text_sha256"))


def outline(text: str = "text") -> Column:
    """A hash that equal texts share and few others do: of the length and of what is at the beginning, in the middle and at the end."""
    whole = F.coalesce(F.col(text), F.lit(""))
    half = F.floor(F.length(whole) / 2).cast("int")
    return F.xxhash64(F.octet_length(whole), *(lower_ascii(F.substring(whole, at, F.lit(PART))) for at in (F.lit(1), half, F.lit(-PART))))


def keep_one(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row, with all columns, of each group of equal texts: that of the largest doc_id.

    Of rows repeated under that id, and of a group in which all ids are null, one row stays, too. Rows
    whose outline no other row has are alone with their text and stay without a shuffle. Only the others
    are compared by their whole texts; they meet their group by digest and id together, so the copies of
    one text are spread over all tasks.
    """
    rows = docs.select(outline().alias("outline"), F.struct(*docs.columns).alias("row"))
    shared = sent_to_all(materialize(rows.groupBy("outline").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("outline")))
    alone = rows.join(shared, "outline", "left_anti").select("row.*")
    docs = materialize(rows.join(shared, "outline", "left_semi").select("row.*"))
    id_or_least = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63))).alias("id")
    groups = text_groups(docs, salts).select("digest", id_or_least("keep_id"))
    rows = docs.select(sha256(normal()).alias("digest"), id_or_least("doc_id"), F.struct(*docs.columns).alias("row"))
    return alone.union(rows.join(groups, ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"]).select("row.*"))
