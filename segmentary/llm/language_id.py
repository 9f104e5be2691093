"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` bytes long holds how often which byte came
next. A byte costs -log2 of its share among what followed the longest context known to the language;
where it never followed there, the escape share of that context is paid and the next shorter context
asked, down to all 256 bytes alike (method C, without exclusions). The statistics are frozen after
training, so the cost of a text is a sum over its bytes, kept in whole 2**-16 bits and thus exact.

All languages share one trie. For the node g reached with a byte and the longest context c before it
the cost is byte[g] + escape[c], where escape[] adds up the escapes of a context and of its shorter
forms, and byte[g] takes off those that are not paid. So a text costs two table lookups a byte and language, and
one a byte for each length of context, all over whole arrays: nodes are numbered by depth, so the
deepest of several is their maximum, and costs are summed a language at a time.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_bucket, keep_rows, map_batches, sampled, texts_of

ORDER = 4
#: Training documents a language, about: the classifier is fitted on a sample of this bound.
SAMPLE = 400
#: Contexts longer than this many bytes are kept only if seen twice.
SURE = 3
#: Fixed point of the code lengths.
ONE = 1 << 16
UND = "und"
#: A text whose best code is no shorter than its plain bytes is in none of the languages.
PLAIN_BITS = 8.0

_letter = regex.compile(r"\p{L}").search


class Model:
    """Frozen statistics of all languages. ``counts``: (lang, bytes) to how often these bytes were seen."""

    def __init__(self, counts: dict[tuple[str, bytes], int], order: int = ORDER) -> None:
        self.order = order
        self.langs = sorted({lang for lang, _ in counts})
        grams = sorted({g for _, g in counts}, key=lambda g: (len(g), g))
        node = {b"": 1} | {g: i + 2 for i, g in enumerate(grams)}
        inner = sorted({node[g[:-1]] for g in grams})
        row = {n: i + 1 for i, n in enumerate(inner)}
        used = sorted({g[0] for g in grams if len(g) == 1})
        self.symbol = np.full(256, len(used), np.int64)
        self.symbol[used] = np.arange(len(used))
        #: child[row[n] + symbol]: node; node 0 and row 0 stand for nothing. Rows are looked up by node.
        self.width = len(used) + 1
        self.row = np.zeros(len(node) + 1, np.int64)
        self.row[list(row)] = np.fromiter(row.values(), np.int64) * self.width
        self.child = np.zeros((len(inner) + 1) * self.width, np.int32)
        for g in grams:
            self.child[self.row[node[g[:-1]]] + self.symbol[g[-1]]] = node[g]
        #: Nodes of one symbol, and of two (width times the first one and the second).
        self.one = self.child[self.row[1] + np.arange(self.width)]
        self.two = self.child[self.row[self.one][:, None] + np.arange(self.width)].ravel()
        n, k = len(node) + 1, len(self.langs)
        escape, cost = np.zeros((n, k)), np.zeros((n, k))
        for j, lang in enumerate(self.langs):
            total, kinds = Counter(), Counter()
            for (of, g), c in counts.items():
                if of == lang:
                    total[g[:-1]] += c
                    kinds[g[:-1]] += 1
            escapes = {c: -math.log2(kinds[c] / (total[c] + kinds[c])) for c in total}
            escape[1, j] = escapes.get(b"", 0.0)
            cost[0, j] = 8.0
            for g in grams:
                i = node[g]
                escape[i, j] = escapes.get(g, 0.0) + escape[node[g[1:]], j]
                seen = counts.get((lang, g))
                if seen:
                    cost[i, j] = -math.log2(seen / (total[g[:-1]] + kinds[g[:-1]]))
                else:
                    cost[i, j] = escapes.get(g[:-1], 0.0) + (cost[node[g[1:]], j] if len(g) > 1 else 8.0)
        parent = np.zeros(n, np.int64)
        for g in grams:
            parent[node[g]] = node[g[:-1]]
        # byte 0 (never seen) pays every escape; another one not those of its own context and the shorter ones
        less = escape[parent]
        less[0] = 0.0
        # by language; each is far below 2^15 bits
        self.escape = np.rint(escape * ONE).astype(np.int32).T.copy()
        self.byte = (np.rint(cost * ONE).astype(np.int32) - np.rint(less * ONE).astype(np.int32)).T.copy()
        self.depth = np.zeros(n, np.int8)
        for g in grams:
            self.depth[node[g]] = len(g)

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Code length of ``data`` for each language, in 2**-16 bits."""
        s = self.symbol[np.frombuffer(data, np.uint8)]
        n = len(s)
        deepest = self.one[s]
        after = np.ones(n + 1, np.int32)  # the longest known context before each byte
        np.maximum(after[1:], deepest, out=after[1:])
        level = deepest
        for k in range(2, min(self.order + 1, n) + 1):
            level = self.two[s[:-1] * self.width + s[1:]] if k == 2 else self.child[self.row[level[:-1]] + s[k - 1 :]]
            np.maximum(deepest[k - 1 :], level, out=deepest[k - 1 :])
            if k <= self.order:
                np.maximum(after[k:], level, out=after[k:])
        return np.array([b.take(deepest).sum(dtype=np.int64) + e.take(after[:-1]).sum(dtype=np.int64) for b, e in zip(self.byte, self.escape, strict=True)])

    def judge(self, text: str) -> tuple[str, float, float]:
        """Language, confidence from 0 to 1, bits a byte under the best code."""
        if not self.langs or _letter(text) is None:
            return UND, 0.0, 0.0
        data = text.encode()
        bits = self.code_lengths(data) / ONE
        best = int(np.argmin(bits))  # of equals the first by name
        spread = 2.0 ** -np.minimum((bits - bits[best]) / math.sqrt(len(data)), 1000.0)
        return self.langs[best], float(1.0 / spread.sum()), float(bits[best] / len(data))


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``rows`` (lang, text) to lang, gram (binary, up to order + 1 bytes), n; counted in the tasks, summed after."""

    def start():
        def apply(batch):
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                data = text.encode()
                for k in range(1, order + 2):
                    found.update((lang, data[i : i + k]) for i in range(len(data) - k + 1))
            return {"lang": [x for x, _ in found], "gram": [g for _, g in found], "n": list(found.values())}

        return apply

    counted = map_batches(rows.select("lang", "text"), start, "lang string, gram binary, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> Model:
    """Fit on documents with a language whose crc32 is not 2 modulo 4, about ``sample`` of each language."""
    usable = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (id_bucket("doc_id", 4) != 2))
    chosen = sampled(usable, "doc_id", "lang", sample).filter(F.col("text").isNotNull())
    counted = count_grams(chosen, order).filter((F.length("gram") <= SURE) | (F.col("n") > 1))
    return Model({(r["lang"], bytes(r["gram"])): r["n"] for r in counted.collect()}, order)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, bits_per_byte.

    ``und`` with score 0 for a null text or one without letters, or if nothing could be learned. Rows
    are judged each by itself, so repeated rows get equal results and an empty table none; whole texts
    are scored; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def apply(batch):
            found = [shared.value.judge(t) for t in texts_of(batch)]
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "bits_per_byte": [x[2] for x in found]}

        return apply

    rows = docs.select("doc_id", "text", (id_bucket("doc_id", 4) == 2).alias("held_out"))
    return map_batches(rows, start, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def language_id(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    return identify(docs, train(docs, order, sample))


def keep_known_languages(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages: not ``und``, and coded in under 8 bits a byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def apply(batch):
            found = [shared.value.judge(t) for t in texts_of(batch)]
            return [lang != UND and bits < PLAIN_BITS for lang, _, bits in found]

        return apply

    return keep_rows(docs, start)
