"""Best-fit packing with certified bin counts.

Documents are tokenised once and cut into pieces. Pieces are dealt over buckets of bounded size; each
bucket is packed by best-fit decreasing, and dual feasible functions give a lower bound on the bins
that its pieces need. A bucket whose count meets its bound is certified. The others keep their full
(or all but full) bins and hand the documents of the rest to the next round, where they meet those of other buckets in
fewer, mixed buckets and are packed again. A round that does not lower the count is thrown away.
"""

from __future__ import annotations

import json
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, materialize, texts_of
from .bpe import read_ranks, vocabulary

CAPACITY = 1024
#: Bins whose gap is no more than this share of the capacity stay as they are.
GAP = 64
#: Pieces that one bucket holds, about.
BUCKET = 20_000
ROUNDS = 3
END = 2


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, behind a first one that may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))] if n else []


def special_tokens(path: str) -> dict[str, int]:
    """The strings that a tokenizers file reads as one id each, wherever they stand in a text."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", ())}


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False, special: dict[str, int] | None = None) -> DataFrame:
    """Pieces of each document's ids and the closing id: doc_id, piece, start, length, ids_crc32 (and ids).

    ``path`` has the ranks of a vocabulary, ``special`` the strings that are one id each. With both from
    one tokenizers file the ids are those of its plain call without added special tokens. A null or
    empty text is one piece of one id.
    """
    data, special = vocabulary(docs.sparkSession, path), dict(special or {})

    def start():
        import tiktoken

        coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(data.value), special_tokens=special)
        ids_of = partial(coder.encode, allowed_special="all", disallowed_special=()) if special else coder.encode_ordinary

        def apply(batch):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))}
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                ids = np.array([*ids_of(text), END], "<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[at : at + n]
                    row = (doc, k, at, n, zlib.crc32(part.tobytes()), *([part.astype("<i4").tolist()] if with_ids else []))
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            return out

        return apply

    return map_batches(docs.select("doc_id", "text"), start, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, fill of each bin. ``lengths`` must not increase."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill, bins, offsets = 0, [], np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        left = mask >> n
        if left:
            k = n + (left & -left).bit_length() - 1
            b = room[k].pop()
            if not room[k]:
                mask &= ~(1 << k)
        else:
            k, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if k - n:
            room[k - n].append(b)
            mask |= 1 << (k - n)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions, in exact integers."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(object)
    size = np.arange(capacity + 1).astype(object)
    n, mass = np.cumsum(count), np.cumsum(count * size)
    best = -(-mass[-1] // capacity)
    for small in range(1, capacity // 2 + 1):  # over capacity - small: 1; under small: 0; else the share
        top = capacity - small
        best = max(best, n[-1] - n[top] + -(-(mass[top] - mass[small - 1]) // capacity))
    for k in range(1, 33):  # ((k + 1) x rounded down) / k, where that is no whole number already
        value = [s * k if (k + 1) * s % capacity == 0 else (k + 1) * s // capacity * capacity for s in range(capacity + 1)]
        best = max(best, -(-int(sum(count * np.array(value, object))) // (k * capacity)))
    return int(best)


def _packer(capacity: int, round_no: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets, fill = best_fit(frame["length"].to_numpy(), capacity)
        certified = len(fill) == lower_bound(frame["length"].to_numpy(), capacity)
        bucket = int(key[0].as_py())
        out = frame[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
            sequence_id=(round_no << 56) + (bucket << 28) + bins, offset=offsets, settled=certified | (fill[bins] >= capacity - capacity // GAP)
        )
        out["doc_id"] = out["doc_id"].astype(pd.Int64Dtype())
        return pa.Table.from_pandas(out, preserve_index=False)

    return pack


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, settled boolean"


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """Place ``pieces`` (doc_id, piece, start, length, ids_crc32; all lengths from 1 to ``capacity``) into sequences.

    Adds sequence_id and offset. Pieces are dealt by a hash that takes in their place in the written table,
    too, so that equal rows are spread, and a repeated task deals them as before. Each round is written to the shared folder, so a lost executor costs
    its own tasks only, and a sequence's members are fixed once written.
    """
    todo, done, n, before = pieces, [], pieces.count(), None  # ``pieces`` is a written table, whose tasks read the same rows again
    for k in range(rounds):
        buckets = max(1, -(-n // bucket))
        dealt = todo.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(k), F.monotonically_increasing_id()), F.lit(buckets)).alias("bucket"))
        packed = materialize(dealt.groupBy("bucket").applyInArrow(_packer(capacity, k), PACKED))
        bins = packed.agg(F.sum((F.col("offset") == 0).cast("long")).alias("all"), F.sum(((F.col("offset") == 0) & ~F.col("settled")).cast("long")).alias("open"), F.sum((~F.col("settled")).cast("long")).alias("n")).first()
        if before is not None and (bins["all"] or 0) >= before[1]:
            break
        if before is not None:
            done[-1] = done[-1].filter("settled")
        done.append(packed)
        before, n, todo = (packed, bins["open"] or 0), bins["n"] or 0, packed.filter("NOT settled")
        if n == 0 or (buckets == 1 and k):
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("settled")


def best_fit_packing(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, special: dict[str, int] | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents over ``capacity`` ids are cut. A null or empty text still takes its closing id. Rows
    are packed each by itself, so repeated rows are packed repeatedly; an empty table gives no rows.
    Further columns are ignored.
    """
    return pack_pieces(materialize(token_pieces(docs, path, pattern, capacity, special=special)), capacity)

