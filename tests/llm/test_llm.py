"""Each operator against a brute-force version, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from segmentary.llm import exact_dedup as E
from segmentary.llm import fingerprint as P
from segmentary.llm import html_text as H
from segmentary.llm import language_id as L
from segmentary.llm import minhash as M
from segmentary.llm import packing as K
from segmentary.llm import token_counts as C
from segmentary.llm import toxicity as T
from segmentary.llm import url_filter as U
from segmentary.llm.bpe import Encoder, Transducer, Utf8Stream, bpe_round_trip, decode_tokens, merge_bytes, read_ranks
from segmentary.llm.components import components
from segmentary.llm.queries import PATTERN, RANKS_50K, RANKS_MULTI, RULES, SPECIAL_50K

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, digest string, n int, v string, score double"
ODD = [
    (1, "Hello the world, you and I.\nSecond line here.", "en", "s"),
    (2, "hello THE world, you and I.\nSecond line here.", "en", "s"),
    (3, None, "en", "s"),
    (4, "", None, "s"),
    (5, " \n\n ", "de", None),
    (6, "日本語のテキスト 🎉 émoji <|endoftext|> ÀÉ", "fr", "s"),
    (7, "x" * 5000 + " " + "long word " * 4000, "en", "s"),
    (8, "123 456 !!!", "en", "s"),
    (8, "123 456 !!!", "en", "s"),
    (9, "one", "en", "s"),
    (10, "<|endoftext|><|endoftext|>x <|endoftext|>\n<|endoftext|> 1", "en", "s"),
    (None, "no id", "en", "s"),
]


def frame(spark, rows):
    """Documents with further columns whose names clash with ours."""
    return spark.createDataFrame([(i, t, lang, s, 0, True, 7, "d", 1, "v", 0.5) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents in two made-up languages, with exact copies, a large group of near copies, and chains."""
    rng = random.Random(3)
    words = {"aa": ["the", "of", "tion", "ing", "heat", "stone", "river", "and"], "bb": ["der", "und", "schaft", "keit", "über", "straße", "nicht", "zu"]}
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "a", "er"]) for _ in range(rng.randint(1, 120))), lang, "s"))
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    for i in range(120, 180):
        near = base.copy()
        near[rng.randrange(150)] = f"z{i}"
        rows.append((i, " ".join(near), "aa", "s"))
    for i in range(180, 190):
        base[(i - 180) * 9] = f"q{i}"
        rows.append((i, " ".join(base), "aa", "s"))
    for i in range(190, 230):
        rows.append((i, rows[i % 7][1].upper() if i % 2 else rows[i % 7][1], "aa", "s"))
    return rows


def test_token_counts(spark, odd, none):
    import tiktoken

    coder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=read_ranks(open(RANKS_50K, "rb").read()), special_tokens={})
    found = collections.defaultdict(list)
    for r in C.token_counts(odd, RANKS_50K, PATTERN).collect():
        found[r["doc_id"]].append(r)
    for i, text, *_ in ODD:
        text, rows = text or "", sorted(found[i], key=lambda r: r["section"])
        lines = text.split("\n")
        want = [a + "\n" for a in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        if i != 8:
            assert [text[r["start_char"] : r["end_char"]] for r in rows] == want
            ids = coder.encode_ordinary(text)
            assert sum(r["n_tokens"] for r in rows) == len(ids) == rows[0]["doc_tokens"]
            raw, owners, at = text.encode(), collections.Counter(), 0
            edges = np.cumsum([len(a.encode()) for a in want])
            for t in ids:
                n = len(coder.decode_single_token_bytes(t))
                shares = collections.Counter(int(np.searchsorted(edges, b, "right")) for b in range(at, at + n))
                owners[max(shares, key=lambda k: (shares[k], -k))] += 1
                at += n
            assert at == len(raw) and [owners[k] for k in range(len(want))] == [r["n_tokens"] for r in rows]
    assert C.token_counts(none, RANKS_50K, PATTERN).count() == 0


def test_attribution_rule():
    counts, crossing = C.attribute(np.array([2, 6, 8]), np.array([4, 8]))
    assert counts.tolist() == [2, 1] and crossing.tolist() == [1, 0]  # of equal shares the earlier section's
    counts, _ = C.attribute(np.array([5, 8]), np.array([2, 8]))
    assert counts.tolist() == [0, 2]


def test_transducer_is_bpe():
    ranks = read_ranks(open(RANKS_MULTI, "rb").read())
    machine, rng = Transducer(ranks), random.Random(1)
    pieces = list(ranks)
    for _ in range(1500):
        word = b"".join(rng.choice(pieces)[: rng.randint(1, 6)] for _ in range(rng.randint(1, 6)))
        assert machine.encode(word) == merge_bytes(word, ranks)
    small = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cab": 259, b"aa": 260, b"aaa": 261}
    machine = Transducer(small)
    for k in range(3**7):
        word = bytes(b"abc"[k // 3**i % 3] for i in range(7))
        assert machine.encode(word) == merge_bytes(word, small)


def test_bpe_round_trip(spark, odd, none):
    import tiktoken

    coder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=read_ranks(open(RANKS_MULTI, "rb").read()), special_tokens={})
    encoded = bpe_round_trip(odd, RANKS_MULTI, PATTERN, ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    found = {r["doc_id"]: r for r in encoded.collect()}
    for i, text, *_ in ODD:
        ids = np.array(coder.encode_ordinary(text or ""), "<u4").tobytes()
        assert bytes(found[i]["ids"]) == ids and found[i]["n_tokens"] == len(ids) // 4
        assert found[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    for step in (1, 3, 4096):
        assert {r["doc_id"]: r["text"] for r in decode_tokens(encoded, RANKS_MULTI, step).collect()} == {i: t or "" for i, t, *_ in ODD}
    assert bpe_round_trip(none, RANKS_MULTI, PATTERN).count() == 0


def test_memo_restarts(monkeypatch):
    monkeypatch.setattr("segmentary.llm.bpe.MEMO", 3)
    monkeypatch.setattr("segmentary.llm.bpe.STATES", 4)
    ranks = read_ranks(open(RANKS_MULTI, "rb").read())
    encoder, text = Encoder(ranks, PATTERN), "several different words overflow the little memo again and again"
    assert encoder.decode(encoder.ids(text)) == text.encode()


def test_utf8_stream():
    rng = random.Random(2)
    for _ in range(3000):
        data = bytes(rng.choice([0x41, 0x80, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0xED, 0xA0, 0xFF]) for _ in range(rng.randint(0, 12)))
        stream, cut = Utf8Stream(), rng.randint(0, 12)
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.close() == data.decode("utf-8", "replace")
        stream = Utf8Stream()
        assert "".join([*(stream.feed(data[i : i + 1]) for i in range(len(data))), stream.close()]) == data.decode("utf-8", "replace")


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert coder.encode("a <|endoftext|> b", add_special_tokens=False).ids.count(50256) == 1
    found = collections.defaultdict(list)
    rows = K.best_fit_packing(odd, RANKS_50K, PATTERN, special=SPECIAL_50K).collect()
    for r in rows:
        found[r["doc_id"]].append(r)
    for i, text, *_ in ODD:
        ids, at = [*coder.encode(text or "", add_special_tokens=False).ids, 2], 0
        pieces = sorted(found[i], key=lambda r: r["piece"])
        if i == 8:
            assert len(pieces) == 2 and pieces[0]["ids_crc32"] == pieces[1]["ids_crc32"]
            continue
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at) and (len(pieces) == 1 or not k or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    check_sequences(rows)
    assert K.best_fit_packing(none, RANKS_50K, PATTERN, special=SPECIAL_50K).count() == 0


def check_sequences(rows):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    return len(bins)


def test_packing_is_tight_over_many_buckets(spark):
    rng = random.Random(4)
    lengths = [rng.choice([1024, 700, 512, 400, 340, rng.randint(1, 1024)]) for _ in range(4000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = K.pack_pieces(pieces, bucket=400).collect()
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    bound = K.lower_bound(np.array(lengths))
    assert bound <= check_sequences(rows) <= len(K.best_fit(np.array(sorted(lengths, reverse=True)))[2]) + 5


def test_bounds_never_exceed_the_best():
    rng = random.Random(5)

    def best(items, capacity):
        items = sorted(items, reverse=True)

        def place(i, bins, most):
            if i == len(items):
                return len(bins)
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                    bins[k] += items[i]
                    most = min(most, place(i + 1, bins, most))
                    bins[k] -= items[i]
            if len(bins) + 1 < most:
                bins.append(items[i])
                most = min(most, place(i + 1, bins, most))
                bins.pop()
            return most

        return place(0, [], len(items) + 1)

    for _ in range(150):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        most = best(items, 20)
        assert K.lower_bound(np.array(items), 20) <= most <= len(K.best_fit(np.array(sorted(items, reverse=True)), 20)[2])
    assert K.lower_bound(np.array([11] * 7), 20) == 7


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and den * len(s & t) >= num * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_dedup(spark, corpus, k, num):
    found = M.near_dedup(frame(spark, corpus), k, (num, 100)).collect()
    assert sorted(tuple(r) for r in found) == brute_components(corpus, k, num, 100)


def test_near_dedup_by_shuffles_and_leaders(spark, corpus, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(M, "SMALL", 2)
    found = M.near_dedup(frame(spark, corpus), 3, (85, 100)).collect()
    assert sorted(tuple(r) for r in found) == brute_components(corpus, 3, 85, 100)


def large_family(k, seed=3, n=200, every=4, share=0.14):
    """Texts of ``n`` words, every fourth of which is one of two: large buckets, and links between any members."""
    rng = random.Random(seed)
    return [(i + 1, " ".join(f"x{at}" if at % every == 0 and rng.random() < share else f"w{at}" for at in range(n))) for i in range(k)]


def test_main_text_beside_a_teaser():
    long = "This is the text of the page and it is in a div that has more of the words which you would read for all that is there. " * 3
    page = f"<body><div>{long}</div><article><p>Read more on this.</p></article></body>"
    assert long.strip() in H.main_text(page)


def test_near_dedup_large_family(spark):
    rows = large_family(500)
    found = M.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()
    assert sorted(tuple(r) for r in found) == brute_components(rows, 3, 85, 100)


def sparse_family(k=300, seed=1):
    """Each text replaces six of 32 places by words of its own: few pairs are linked, and no text leads."""
    rng, rows = random.Random(seed), []
    for i in range(k):
        words = [f"b{j}" for j in range(300)]
        for slot in rng.sample(range(32), 6):
            words[9 * slot] = f"own{i}x{slot}"
        rows.append((i + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [1 << 14])
def test_near_dedup_sparse_family(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = sparse_family()
    found = M.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()
    assert sorted(tuple(r) for r in found) == brute_components(rows, 3, 85, 100)


def test_common():
    rng = np.random.default_rng(4)
    xs, ys = ([np.unique(rng.integers(0, top, size)).astype(np.uint64) for top in (50, 9000) for size in range(1, 400, 9)] for _ in range(2))
    assert M.common(xs, ys).tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]


def test_near_dedup_odd(spark, odd, none):
    found = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_dedup(odd, 3, (85, 100)).collect())
    by_id = {f[0]: f[1:] for f in found}
    assert len(found) == len(ODD) and by_id[2] == (7, 1, False) and by_id[3] == (0, 3, True) and by_id[9] == (1, 9, True)
    assert by_id[-1] == (1, None, True) and by_id[8] == (1, 8, True)
    assert M.near_dedup(none).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {a: find(a) for a in root if find(a) != a}


def brute_rule(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


def test_url_filter(spark):
    rng = random.Random(9)
    labels, parts = ["org", "com", "example", "a", "b-c", "a.b"], ["", "/", "/en", "/en/1", "/en/12", "/x", "/\U0010ffff", "/é"]
    rules = {(".".join(rng.sample(labels, rng.randint(1, 3))), rng.choice(parts)): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{'.'.join(rng.choices(labels, k=rng.randint(1, 4))).upper() if rng.random() < 0.3 else '.'.join(rng.choices(labels, k=rng.randint(1, 4)))}{rng.choice(parts)}{rng.choice(['', '3', '?q=/', '#f', '/z'])}" for _ in range(400)]
    urls += [None, "", "no host", "://", "x://org", "http://org/"] + ["https://a.example.org/en/1"] * 300
    pages = spark.createDataFrame([(i % 500, u, 1, "x") for i, u in enumerate(urls)] + [(5, urls[5], 1, "x")], "page_id long, url string, range int, key string")
    found = U.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=7).collect()
    assert collections.Counter(tuple(r) for r in found) == collections.Counter((i % 500, *brute_rule(u, rules)) for i, u in [*enumerate(urls), (5, urls[5])])
    nothing = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in U.url_filter(pages, nothing, "block").collect()} == {"block"}
    assert U.url_filter(pages.limit(0), spark.sql(f"SELECT * FROM {RULES}")).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>Site <a href=x>Home</a></header>
<nav><ul><li><a href=/a>A</a></ul></nav><div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header>
<p>Short.<p>He said &lt;b&gt; a<b>b</b>c&nbsp;d
 and more.<aside>side</aside><script>x="</p>";</script><div class="ad">buy</div><form><p>mail</form><ul class="share"><li>tweet</ul></article>
<section id="comments"><article class="comment"><p>first!</article></section></main><footer>foot</footer>"""


def test_main_text(spark):
    assert H.main_text(PAGE) == "Title & more\n\nShort.\n\nHe said <b> abc d and more."
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (3, "u", "", "t"), (4, "u", "<article>&am", "t"), (5, "u", "<p" * 3000, "t")], "page_id long, url string, html string, text string")
    found = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in H.extract(pages).collect()}
    assert found[2] == (None, "", 0) and found[3] == ("u", "", 0) and found[4] == ("u", "&am", 3) and found[1][2] == len(found[1][1])
    assert H.extract(pages).count() == 6 and H.extract(pages.limit(0)).count() == 0


def test_block_rules():
    good = "The fox was in the house and it is of no use to us, but they had been there before all of this and then left for the sea on a day that was cold and that we will not forget, for it is the last of the year."
    bad = "Lorem widgets gadgets gizmos buttons bargains discounts coupons vouchers offers deals sales prices items products"
    page = lambda *blocks: "".join(f"<p>{b}</p>" for b in blocks)
    assert H.main_text(page(good, "Yes.", good)) == f"{good}\n\nYes.\n\n{good}"
    assert H.main_text(page(bad, "No.", bad)) == ""
    assert H.main_text(page(good, "near", "x", "far", bad)) == f"{good}\n\nnear"
    assert H.main_text(page(good, f"<a href=x>{good}</a>")) == good


def test_language_id(spark, corpus, odd, none):
    model = L.train(frame(spark, corpus))
    found = {r["doc_id"]: r for r in L.identify(frame(spark, corpus), model).collect()}
    right = [found[i]["lang_pred"] == lang for i, _, lang, _ in corpus if found[i]["held_out"]]
    assert len(right) > 20 and sum(right) / len(right) > 0.9
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in corpus)
    found = {r["doc_id"]: r for r in L.identify(odd, model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (3, 4, 5, 8)) and found[6]["lang_pred"] != "und"
    empty = L.train(none)
    assert {r["lang_pred"] for r in L.identify(odd, empty).collect()} == {"und"} and L.identify(none, model).count() == 0
    kept = L.keep_known_languages(odd, model)
    assert kept.columns == odd.columns and not {r["doc_id"] for r in kept.collect()} & {3, 4, 5, 8}


def test_code_lengths_by_definition(spark):
    rng, order, counts = random.Random(10), 3, collections.Counter()
    for lang, letters in (("aa", b"abc"), ("bb", b"bcd")):
        for _ in range(20):
            data = bytes(rng.choice(letters) for _ in range(30))
            counts.update((lang, data[i : i + k]) for k in range(1, order + 2) for i in range(len(data) - k + 1))
    model = L.Model(counts, order)

    def cost(lang, context, byte):
        while True:
            after = {g[-1]: n for (of, g), n in counts.items() if of == lang and len(g) == len(context) + 1 and g[:-1] == context}
            if byte in after:
                return escape - np.log2(after[byte] / (sum(after.values()) + len(after))) if (escape := spent[0]) is not None else 0
            if after:
                spent[0] += -np.log2(len(after) / (sum(after.values()) + len(after)))
            if not context:
                return spent[0] + 8.0
            context = context[1:]

    for data in (b"abcabc", b"dddd", b"zab", b"a", b"cbdz"):
        for j, lang in enumerate(model.langs):
            total = 0.0
            for i, byte in enumerate(data):
                spent = [0.0]
                total += cost(lang, data[max(0, i - order) : i], byte)
            assert model.code_lengths(data)[j] / L.ONE == pytest.approx(total, abs=1e-3)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_levenshtein_automaton():
    rng = random.Random(11)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        k = rng.randint(0, 2)
        machine = T.LevenshteinAutomaton(a, k)
        state = machine.start()
        for c in b:
            state = machine.step(state, c)
        assert machine.edits(state) == (edits(a, b) if edits(a, b) <= k else None)


def test_context_and_misspelling():
    model = T.Model({"moron": 1.0, "disgusting": 1.0}, {"réeux": 1.0}, frozenset({"maroon"}))
    assert model.load("you moron") > model.load("a moron") > model.load("the word moron") > model.load('he said "a moron" to him') > 0
    assert 0 < model.load("a morron") < model.load("a moron") and 0 < model.load("so disgustnig") and model.load("maroon oron") == 0
    assert model.load("a réeuxment") == 1.0 and model.load("a m0ron") > 0


def test_misspelling_of_words_under_a_learned_stem():
    texts = [(1, f"you are stupid a{i}") for i in range(60)] + [(1, "stupid$$$ you")] * 5 + [(1, f"such a moron b{i}") for i in range(40)] + [(0, f"fine words c{i}") for i in range(200)]
    counts = collections.Counter((f, y) for y, t in texts for f in T.features(t))
    rows = [(f, counts[f, 1], counts[f, 0]) for f in sorted({f for f, _ in counts})]
    found = T.choose(rows, 105, 200)
    assert "stupi" in found[1] and "stupid" not in found[0]
    model = T.Model(*found[:2], frozenset(), (3.0, -2.0), *found[2:])
    for word in ("stuppid", "stupd", "atupid", "tupid", "sstupid", "noron", "mmoron"):
        assert 0 < model.weight(word) < 1, word
    assert not model.weight("tpid") and not model.weight("fine") and not model.weight("staple")


def test_near_is_exhaustive():
    rng = random.Random(13)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 11))): 0.5 for _ in range(60)}
    trie = T.Trie(words, {}, {})
    for _ in range(800):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(3, 11)))
        best = min(((e, w) for w in words if (e := edits(word, w)) <= min(*((len(x) >= 5) + (len(x) >= 9) for x in (word, w))) and len(word) >= 5), default=None)
        found = trie.near(word)
        assert (found and found[1:]) == best


def test_toxicity(spark, none, odd):
    rng, rows, labels = random.Random(12), [], []
    for i in range(600):
        words, bad = [rng.choice(["stone", "river", "heating", "of", "and"]) + rng.choice(["", "a", "th"]) for _ in range(40)], i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["scumbag", "pathetic"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    labels = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    found = {r["doc_id"]: r for r in T.toxicity(docs, labels).collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    assert all(found[i]["predicted"] == int(i % 4 == 0) == int(found[i]["score"] >= 0.5) for i in range(600))
    kept = T.keep_clean(docs, T.train(docs, labels))
    assert kept.columns == docs.columns and kept.count() == 450
    assert {r["predicted"] for r in T.toxicity(odd, labels.limit(0)).collect()} == {0}
    assert T.toxicity(none, labels).count() == 0


def test_exact_dedup(spark, corpus, odd, none):
    for docs, rows in ((frame(spark, corpus), corpus), (odd, ODD)):
        groups = collections.defaultdict(list)
        low = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for i, t, *_ in rows:
            groups[low(t)].append(i)
        top = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
        want = collections.Counter((i, top[low(t)], len(groups[low(t)]), i == top[low(t)], hashlib.sha256(low(t).encode()).hexdigest()) for i, t, *_ in rows)
        assert collections.Counter(tuple(r) for r in E.exact_dedup(docs).collect()) == want
        one = E.keep_one(docs)
        assert one.columns == docs.columns
        assert sorted((str(r["doc_id"]), low(r["text"])) for r in one.collect()) == sorted((str(top[t]), t) for t in groups)
    assert E.exact_dedup(none).count() == 0


def test_exact_dedup_never_merges_by_digest(spark):
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text)), 4, "0"))
    same = frame(spark, [(1, "Ab", "en", "s"), (2, "aB", "en", "s"), (3, "abc", "en", "s")])
    assert E.exact_dedup(same, digest=weak).count() == 3
    with pytest.raises(Exception, match="share the digest"):
        E.exact_dedup(frame(spark, [(1, "ab", "en", "s"), (2, "cd", "en", "s")]), digest=weak).collect()


def test_fingerprints(spark, corpus, odd, none):
    for docs, rows in ((frame(spark, corpus), corpus), (odd, ODD)):
        found = P.fingerprint_edits(docs, ranges=5).collect()
        order = sorted(((i if i is not None else -1, t or "") for i, t, *_ in rows), reverse=True)
        want = collections.Counter()
        for k, (i, t) in enumerate(order):
            after, n = order[(k + 1) % len(order)][1], len(t)
            want[i, n, hashlib.sha256((t[: n - n // 2] + after[: n // 2]).encode()).hexdigest()] += 1
        assert collections.Counter((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["edited_sha256"]) for r in found) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
        prints = {r["doc_id"]: r["fingerprint"] for r in P.fingerprints(docs).collect()}
        assert all(prints[r["doc_id"]] == r["fingerprint"] for r in found)
        texts = collections.defaultdict(set)
        for i, t, *_ in rows:
            texts[t or ""].add(prints[i])
        assert all(len(p) == 1 for p in texts.values()) and len({next(iter(p)) for p in texts.values()}) == len(texts)
    assert P.fingerprint_edits(none).count() == 0 and P.fingerprint_edits(frame(spark, ODD[:1])).first()["near_next"] == 1.0


def test_fingerprints_are_homomorphic(spark):
    rows = spark.createDataFrame([("a b c\nd e f", "d e f\na b c", "a b c", "d e f")], "x string, y string, p string, q string")
    for name in ("x", "y", "p", "q"):
        rows = P.vector_of(rows, name, f"v{name}")
    v = {n: F.col(f"v{n}") for n in "xypq"}
    assert list(rows.select(v["x"] == v["y"], P.added(v["p"], v["q"]) == v["x"], P.added(v["x"], v["q"], -1) == v["p"], P.likeness(v["x"], v["y"])).first()) == [True, True, True, 1.0]


def test_shared_folder(spark, tmp_path, monkeypatch):
    from segmentary.llm import _common

    assert _common.shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or _common._own_dir())
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        _common.shared_dir(away)
    monkeypatch.setattr(_common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert _common.materialize(spark.range(5)).count() == 5
    assert list((tmp_path / "segmentary").glob("*/*/*.parquet"))
    _common.release(spark)
    assert not list((tmp_path / "segmentary").iterdir())
