"""The toxicity score by its definition, and a lexicon that families of copies don't get into."""

import random
import zlib

import pytest

from segmentary.llm import toxicity as T


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def brute_weight(word, words, stems, covered, ordinary):
    exact = lambda w: max([words.get(w, 0.0), *(x for s, x in stems.items() if w.startswith(s))])
    if exact(word) or word in ordinary:
        return exact(word)
    plain = word if word.isalpha() else word.translate(T._leet)
    if exact(plain):
        return exact(plain)
    entries = {**{w: max(x, exact(w)) for w, x in covered.items()}, **words}
    near = [(e, -x) for w, x in entries.items() if (e := edits(plain, w)) <= min(T.allowed(plain), T.allowed(w)) and T.allowed(plain)]
    return -min(near)[1] * T.MISSPELLED ** min(near)[0] if near else 0.0


def test_score_by_definition():
    rng = random.Random(21)
    word = lambda low, high: "".join(rng.choice("abco") for _ in range(rng.randint(low, high)))
    words, covered = {word(4, 11): rng.choice([0.5, 1.0]) for _ in range(25)}, {word(6, 11): 0.7 for _ in range(10)}
    stems = {word(4, 6): 0.8 for _ in range(6)}
    model = T.Model(words, stems, frozenset(word(5, 7) for _ in range(30)), (2.0, -1.0), covered)
    for _ in range(300):
        text = " ".join(rng.choice([word(3, 12), word(3, 12).replace("o", "0"), *words, "you", "said", '"', "\n"]) for _ in range(rng.randint(0, 15)))
        want = sum(brute_weight(m[0], words, stems, covered, model.ordinary) * model.use(text, m.start(), m.end()) for m in T._words.finditer(text))
        assert model.load(text) == pytest.approx(want, abs=1e-12)
        assert model.score(text) == T.curve_at(model.load(text), model.curve)


def test_families_of_copies_lend_no_words(spark):
    rng, rows, labels = random.Random(22), [], []
    plain = lambda n: [rng.choice(["stone", "river", "heating", "of", "and", "sea"]) + rng.choice(["", "a", "th", "ing"]) for _ in range(n)]
    for i in range(700):
        words, bad = plain(60), i % 4 == 0
        if bad:
            words[rng.randrange(60)] = rng.choice(["scumbag", "pathetic"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    family = [f"quixo{k}tl" for k in range(80)]  # clean words in sixty copies, all of them marked toxic for one insult
    for i in range(700, 760):
        words = [*family, "scumbag"]
        words[rng.randrange(80)] = f"own{i}"
        rows.append((i, " ".join(words)))
        labels.append((i, 1))
    rows.append((1, None))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(docs, labels)
    assert model.score(" ".join(family)) < 0.5 < model.score("you scumbag") and not model.weight("quixo7tl")
    judged = {r["doc_id"]: r["score"] for r in T.judge(docs.filter("text IS NOT NULL"), model).collect()}
    assert all(judged[i] == model.score(t) for i, t in rows if t is not None)
    assert any(zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows)
