"""What the stages of the pipeline don't do for rows that need it not, with the same results."""

import random

import corpus_pipeline
import pytest
from test_toxicity import edits

from segmentary.llm import _common
from segmentary.llm import exact_dedup as E
from segmentary.llm import minhash as M
from segmentary.llm import toxicity as T

DOCS = "doc_id long, text string, lang string"


def test_words_unlike_all_entries_are_not_searched(monkeypatch):
    rng, calls = random.Random(5), []
    word = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    entries = {word("abc", 5, 12): 1.0 for _ in range(60)}
    trie = T.Trie(entries, {})
    trie.near("aaaaa")
    shortened = T.shortened
    monkeypatch.setattr(T, "shortened", lambda *a: calls.append(a) or shortened(*a))
    assert not any(trie.near(word("xyz", 5, 14)) for _ in range(300)) and not calls
    for k in (0, 1, 2, 3):
        for _ in range(150):
            near = rng.choice(list(entries))
            for _ in range(k):
                at, what = rng.randint(0, len(near)), rng.randint(0, 2)
                near = near[:at] + rng.choice(("", *"abcx")) * (what < 2) + near[at + (what > 0) :]
            best = min((e for w in entries if (e := edits(near, w)) <= min(T.allowed(near), T.allowed(w))), default=None) if T.allowed(near) else None
            assert (found := trie.near(near)) is None and best is None or found[1] == best


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_texts_alone_are_not_compared(spark, monkeypatch, most):
    """Only rows of a shared outline are grouped by their whole texts; an outline alone makes no texts equal."""
    side, compared = "Same and same again, " * 20, []
    rows = [(i, f"text {i} " * (i % 7 + 1), "en") for i in range(300)]
    rows += [(300, "Some Text É", "en"), (301, "sOME tEXT É", "en"), (302, "some text é", "en"), (303, None, "en"), (304, "", "en"), (None, "some text É", "en"), (305, "Twice", "en"), (305, "twicE", "en")]
    rows += [(310, f"{side}a{side}{side}", "en"), (311, f"{side}b{side}{side}", "en"), (312, f"{side.upper()}A{side}{side}", "en")]
    groups = E.text_groups
    monkeypatch.setattr(_common, "BROADCAST_KEYS", most)
    monkeypatch.setattr(E, "text_groups", lambda docs, *a: compared.append(docs.count()) or groups(docs, *a))
    found = E.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(r["doc_id"] for r in found.collect()) == [*range(300), 301, 302, 304, 305, 311, 312]
    assert compared and compared[0] < 20


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_only_texts_asked_are_joined(spark, monkeypatch, most):
    """Pairs too many to be sent meet the texts of their own ids, not those of the whole table."""
    words, written, materialize = [f"w{i}" for i in range(40)], [], _common.materialize
    docs = spark.createDataFrame([(i, " ".join(words[: 40 - i % 3] if i < 10 else [f"{i}_{w}" for w in words]), "en") for i in range(200)], DOCS)
    pairs = materialize(spark.createDataFrame([(1, 0), (2, 1), (50, 3), (60, 50), (9, 6)], "u long, v long"))
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(_common, "BROADCAST_KEYS", most)
    monkeypatch.setattr(M, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    assert sorted(tuple(r) for r in M.verify(pairs, docs, 3, (90, 100)).collect()) == [(1, 0), (2, 1), (9, 6)]
    assert [t.count() for t in written if "text" in t.columns] == [8]


def test_near_copies_by_shuffles(spark, monkeypatch):
    from test_llm import brute_components, large_family

    rows = large_family(60)
    monkeypatch.setattr(_common, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    found = corpus_pipeline.no_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in found.collect()) == [i for i, _, _, kept in brute_components(rows, 5, 80, 100) if kept]
