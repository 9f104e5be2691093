"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled documents: whole words and word stems that stand out in toxic
ones. Words of a text meet it through a trie: an exact word, a word that begins with a learned stem, or
a misspelled word, which the automaton of the word accepts in its intersection with the trie; that
holds for whole words under a stem, too, and for any letter of a word of ``FUZZY`` letters. Each hit
counts by how it is used: within quotation marks or beside a word of reporting it weighs less than
when it addresses somebody. A logistic curve fitted on the same labelled sample makes that a score.

Near copies of one text are no independent evidence: a family of them would lend all its words to the
lexicon. So of the sample's texts that share a label and a minhash only one is learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_bucket, keep_rows, map_batches, materialize, sampled, texts_of
from .minhash import Shingler, minhashes

#: Labelled documents that the classifier is fitted on, about: of label 1 and of label 0.
SAMPLE = {1: 2000, 0: 4000}
#: Entries of the lexicon at most, those with most evidence first.
ENTRIES = 2000
#: Lengths of stems, and from which length on a word may be misspelled once and twice.
STEMS, FUZZY = range(4, 9), (5, 9)
WINDOW = 60
QUOTED, REPORTED, ADDRESSED, MISSPELLED = 0.35, 0.6, 1.25, 0.5
#: Share of a stem's toxic documents that a word under it must have for its misspellings to count.
COVER = 0.1
MEMO = 1 << 17

_words = re.compile(r"[\w@$]+")
_open, _close = "\"“„«‹‘", "\"”“»›’"
_reporting = re.compile(r"\b(?:said|says|called|quoted?|wrote|according|term|word|slur|sagte|nannte|zitat|laut|wort|dit|selon|mot|appelé|dijo|según|palabra|llamó)\b")
_address = re.compile(r"\b(?:you|your|you're|ur|du|dich|dir|ihr|euch|tu|toi|vous|tú|usted|ustedes|vos)\b")
_leet = str.maketrans("013457@$", "oieastas")


class LevenshteinAutomaton:
    """Accepts the words within ``k`` edits of ``word``. A state is a tuple of (position, edits), without those that another one covers."""

    def __init__(self, word: str, k: int) -> None:
        self.word, self.k = word, k

    def start(self) -> tuple:
        return self._reduced({(i, i) for i in range(min(self.k, len(self.word)) + 1)})

    def _reduced(self, states: set) -> tuple:
        return tuple(sorted(s for s in states if not any(t != s and abs(t[0] - s[0]) <= s[1] - t[1] for t in states)))

    def step(self, state: tuple, char: str) -> tuple:
        out = set()
        for i, e in state:
            for skip in range(self.k - e + 1):  # letters of the word left out
                at = i + skip
                if at < len(self.word) and self.word[at] == char:
                    out.add((at + 1, e + skip))
            if e < self.k:
                out |= {(i, e + 1), (i + 1, e + 1)} if i < len(self.word) else {(i, e + 1)}
        return self._reduced(out)

    def edits(self, state: tuple) -> int | None:
        """Edits if the word may end in this state."""
        return min((e + len(self.word) - i for i, e in state if e + len(self.word) - i <= self.k), default=None)


def allowed(word: str) -> int:
    """Edits that a word of this length may have."""
    return (len(word) >= FUZZY[0]) + (len(word) >= FUZZY[1])


def shortened(word: str, k: int) -> set[str]:
    """The word with up to ``k`` letters left out. Words within ``k`` edits have one of these in common."""
    out = last = {word}
    for _ in range(k):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def sides(entries: list[str], k: int) -> dict[int, list[tuple[slice, set[str]]]]:
    """By the length of a word, where it has a part of an entry if it is within ``k`` edits of it, and the parts that may be there.

    Of k + 1 parts one has no edit: the first one then begins the word, the last one ends it, and another one is moved by up to k letters.
    """
    found: dict[int, dict[tuple, set[str]]] = {}
    for w in entries:
        cuts = [i * len(w) // (k + 1) for i in range(k + 2)]
        for n in range(len(w) - k, len(w) + k + 1):
            for i, (a, b) in enumerate(pairwise(cuts)):
                for shift in {0} if i == 0 else {n - len(w)} if i == k else range(-k, k + 1):
                    if 0 <= a + shift and b + shift <= n:
                        found.setdefault(n, {}).setdefault((a + shift, b + shift), set()).add(w[a:b])
    return {n: [(slice(*at), parts) for at, parts in x.items()] for n, x in found.items()}


class Trie:
    """Words, and stems that any ending may follow, with weights. ``covered``: words under a stem, which only misspellings need."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], covered: dict[str, float] | None = None) -> None:
        self.root: dict = {}
        for table, mark in ((words, "="), (stems, "*")):
            for word, weight in table.items():
                node = self.root
                for c in word:
                    node = node.setdefault(c, {})
                node[mark + "w"] = (word, weight)
        for word, weight in (covered or {}).items():
            known, node = self.exact(word), self.root
            for c in word:
                node = node.setdefault(c, {})
            node["~w"] = (word, max(weight, known))
        self.entries = [w for w in {**words, **(covered or {})} if allowed(w)]
        self.shapes: tuple[tuple[dict[int, list[tuple[slice, set[str]]]], set[str]], ...] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shapes": None}

    def worth_it(self, word: str, k: int) -> bool:
        """Whether an entry may be near: ``k`` edits leave one of k + 1 parts of it whole, and words equal but for k letters each.

        The parts come first, as few words have one where entries of about their length have it.
        """
        if self.shapes is None:
            self.shapes = tuple((sides(near, e), {x for w in near for x in shortened(w, e)}) for e in (1, 2) if (near := [w for w in self.entries if allowed(w) >= e]))
        for e, (parts, short) in enumerate(self.shapes[:k], 1):
            for at, known in parts.get(len(word), ()):
                if word[at] in known:
                    if not short.isdisjoint(shortened(word, e)):
                        return True
                    break
        return False

    def exact(self, word: str) -> float:
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            if "*w" in node:
                best = max(best, node["*w"][1])
        return max(best, node["=w"][1]) if "=w" in node else best

    def near(self, word: str) -> tuple[float, int, str] | None:
        """Weight, edits and entry of the best entry that the automaton of ``word`` accepts."""
        k = allowed(word)
        if not k or not self.worth_it(word, k):
            return None
        machine, best = LevenshteinAutomaton(word, k), None
        todo = [(self.root, machine.start())]
        while todo:
            node, state = todo.pop()
            if (end := node.get("=w") or node.get("~w")) and (edits := machine.edits(state)) is not None:
                entry, weight = end
                if edits <= allowed(entry):
                    found = (weight, edits, entry)
                    best = min(best or found, found, key=lambda x: (x[1], -x[0], x[2]))
            for c, to in node.items():
                if len(c) == 1 and (after := machine.step(state, c)):
                    todo.append((to, after))
        return best


class Model:
    """Lexicon, ordinary words that only look like its entries, and the curve."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], ordinary: frozenset = frozenset(), curve: tuple[float, float] = (3.0, -2.0), covered: dict[str, float] | None = None) -> None:
        self.trie, self.ordinary, self.curve = Trie(words, stems, covered), ordinary, curve
        self.memo: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def weight(self, word: str) -> float:
        known = self.memo.get(word)
        if known is None:
            known = self.trie.exact(word)
            if not known and word not in self.ordinary:
                plain = word if word.isalpha() else word.translate(_leet)
                known = self.trie.exact(plain) if plain != word else 0.0
                if not known and (found := self.trie.near(plain)):
                    known = found[0] * MISSPELLED ** found[1]
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = known
        return known

    def load(self, text: str) -> float:
        """Sum of the hits' weights, each by its context."""
        lowered = text.lower()
        weight, memo = self.weight, self.memo
        if not any([memo[w] if w in memo else weight(w) for w in _words.findall(lowered)]):
            return 0.0
        return sum(w * self.use(lowered, m.start(), m.end()) for m in _words.finditer(lowered) if (w := weight(m[0])))

    def use(self, text: str, start: int, end: int) -> float:
        """How much a hit counts where it stands."""
        before, after = text[max(0, start - WINDOW) : start].rpartition("\n")[2], text[end : end + WINDOW].partition("\n")[0]
        factor = 1.0
        for a, b in zip(_open, _close, strict=True):
            opened = before.count(a) % 2 if a == b else before.rfind(a) > before.rfind(b)
            if opened and b in after:
                factor *= QUOTED
                break
        if _reporting.search(before) or _reporting.search(after):
            factor *= REPORTED
        if _address.search(before[-25:]) or _address.search(after[:25]):
            factor *= ADDRESSED
        return factor

    def score(self, text: str) -> float:
        return curve_at(self.load(text), self.curve)


def curve_at(load: float, curve: tuple[float, float]) -> float:
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, curve[0] * math.log1p(load) + curve[1]))))


def fit_curve(loads: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on log(1 + load) by Newton's method, with a weak pull to no slope."""
    x, y, w = np.log1p(loads), labels.astype(float), np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.02 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.02 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def features(text: str) -> set[str]:
    """Words of a text as ``=word`` and their stems as ``*stem``."""
    words = set(_words.findall(text.lower()))
    return {"=" + w for w in words if len(w) > 2} | {"*" + w[:k] for w in words for k in STEMS if len(w) > k}


def evidence(a: int, b: int, base: float) -> float:
    """Twice the log-likelihood ratio of a feature in ``a`` toxic and ``b`` clean documents against their share ``base``."""
    p = a / (a + b)
    return 2 * (a * math.log(p / base) + (b * math.log((1 - p) / (1 - base)) if b else 0.0))


def choose(counts: list[tuple[str, int, int]], n1: int, n0: int, tried: int | None = None) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Entries from (feature, toxic documents, clean documents), those of most evidence first.

    They are far commoner in toxic documents than chance allows among ``tried`` features, and none is
    one that another makes needless. Words, stems, and of the words that a stem makes needless those
    whose misspellings still count.
    """
    if not n1 or not n0:
        return {}, {}, {}
    base, bar = n1 / (n1 + n0), 2 * math.log(max(tried or len(counts), 2)) + 2
    rated = []
    for f, a, b in counts:
        if b / n0 <= 0.1 * a / n1 and (found := evidence(a, b, base)) >= bar:
            rated.append((found, f[0] == "=", len(f), f, a, min(1.0, (math.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1)))) / 4)))
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    covered: dict[str, float] = {}
    seen: dict[str, int] = {}  # toxic documents of each stem taken
    taken: Counter = Counter()  # of each beginning the documents that entries of more letters explain
    for _, whole, _, f, a, weight in sorted(rated, key=lambda x: (-x[0], not x[1], -x[2], x[3])):
        body = f[1:]
        under = next((body[:k] for k in range(1, len(body) + 1) if body[:k] in stems), None)
        if under is not None:
            if whole and a >= COVER * seen[under]:
                covered[body] = weight
            continue
        if len(words) + len(stems) >= ENTRIES:
            continue
        if not whole and taken[body] >= 0.9 * a:
            continue
        (words if whole else stems)[body] = weight
        if not whole:
            seen[body] = a
        for k in range(1, len(body) + 1):
            taken[body[:k]] += a
    return words, stems, covered


def independent(rows: DataFrame) -> DataFrame:
    """Of the texts (y, text) of one label that share the first or then the second of two minhashes of their word triples, one."""

    def start():
        shingler = Shingler(3)

        def apply(batch):
            keys = [minhashes(shingler.of(t), 2).view(np.int64).tolist() for t in texts_of(batch)]
            return {"y": batch.column(0), "text": batch.column(1), "a": [a for a, _ in keys], "b": [b for _, b in keys]}

        return apply

    out = map_batches(rows, start, "y int, text string, a long, b long")
    for key in ("a", "b"):
        out = out.groupBy("y", key).agg(F.min_by(F.struct("text", "b"), F.struct(F.xxhash64("text"), "text")).alias("m")).select("y", "m.*")
    return out.select("y", "text")


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """Fit on labelled documents whose crc32 is not 0 modulo 5, about ``sample`` of each label.

    Without toxic and clean labels the lexicon is empty and every score under a half.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(F.col("toxic").isin(0, 1) & (id_bucket("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = sampled(usable, "doc_id", "y", sample)  # bounded by ``sample``, so it may be broadcast
    rows = materialize(docs.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(chosen), "doc_id").select("y", "text"))
    rows = materialize(independent(rows))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    def counting():
        def apply(batch):
            found: Counter = Counter()
            for y, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                found.update((f, y) for f in features(text))
            return {"f": [f for f, _ in found], "y": [y for _, y in found], "n": list(found.values())}

        return apply

    counted = map_batches(rows, counting, "f string, y int, n long").groupBy("f").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    counted = materialize(counted.filter("a > 2"))
    tried = counted.count()
    # those far from the bounds of ``choose`` stay on the executors
    rated = [tuple(r) for r in counted.filter((F.col("b") * n1 <= 0.11 * F.col("a") * n0) & (F.col("a") * 2 * math.log((n1 + n0) / n1) >= 2 * math.log(max(tried, 2)))).collect()] if n1 and n0 else []
    words, stems, covered = choose(rated, n1, n0, tried)
    first = Model(words, stems, covered=covered)
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def lookalikes():
        def apply(batch):
            model, found = shared.value, Counter()
            for y, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                if y == 0:
                    found.update(w for w in set(_words.findall(text.lower())) if model.weight(w) and not model.trie.exact(w))
            return {"w": list(found)}

        return apply

    ordinary = frozenset(r["w"] for r in map_batches(rows, lookalikes, "w string").distinct().collect()) if words or covered else frozenset()
    second = Model(words, stems, ordinary, covered=covered)
    if (not words and not stems) or not n1 or not n0:
        return second
    again = docs.sparkSession.sparkContext.broadcast(second)

    def loading():
        def apply(batch):
            return {"y": batch.column(0), "load": [again.value.load(t) for t in texts_of(batch)]}

        return apply

    points = map_batches(rows, loading, "y int, load double").groupBy("y", F.round("load", 3).alias("load")).agg(F.count(F.lit(1)).alias("n")).collect()
    loads = np.repeat([p["load"] for p in points], [p["n"] for p in points])
    return Model(words, stems, ordinary, fit_curve(loads, np.repeat([p["y"] for p in points], [p["n"] for p in points])), covered)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    A null text counts as empty and gets the score of a text without hits. Rows are judged each by
    itself, so repeated rows get equal results and an empty table none; whole texts are read; further
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def apply(batch):
            scores = [shared.value.score(t) for t in texts_of(batch)]
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return apply

    rows = docs.select("doc_id", "text", (id_bucket("doc_id", 5) == 0).alias("held_out"))
    return map_batches(rows, start, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, train(docs, labels))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def apply(batch):
            return [shared.value.score(t) < 0.5 for t in texts_of(batch)]

        return apply

    return keep_rows(docs, start)
