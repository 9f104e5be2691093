"""Near-duplicate detection by MinHash with tensored banding.

Two small collections of ``half`` hashes each, A and B, of ``rows`` minhashes each, are computed for a
document; table (i, j) is keyed by A[i] with B[j]. So half * half tables cost 2 * half * rows minhashes
rather than half * half * 2 * rows. A document that shares no A[i] with another drops out before its
table keys are formed.

1. Documents with one shingle set are one class, represented by its smallest id.
2. Representatives meet in tables. Of buckets with the same members one is kept. A member's weight is
   the size of all its buckets together, which is large for the text that a family of copies comes
   from. Each member is paired with the bucket's leader, the heaviest: as many pairs as members.
3. Pairs are verified on the full shingle sets, and verified links give components.
4. Of a bucket whose members are then still in several components, all pairs across components are
   decided: in a small one (``SMALL``) as pairs like those of step 3. Larger ones that share members
   are a family; its members are dealt into blocks of bounded size, those of a large component into
   blocks of its own, and for each two blocks that aren't of one component a task holds all sets of the
   one against all of the other, by a product of matrices. So no pair of a large bucket is a row
   anywhere, none across components is left out, none within a large component is asked again, and a
   member is sent as often as its family has blocks of other components.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, materialize, sent_to_all
from .components import components

HALF, ROWS = 8, 2
SMALL = 16
#: Shingles of a block of a family, about; a member counts as MEMBER more, so that members are bounded, too.
BLOCK, MEMBER = 1 << 17, 128
#: Shingles that are a matrix at a time.
COLUMNS = 1 << 12
#: Ids or pairs (16 bytes each) up to which they are sent to all executors; above, tables are joined by shuffles.
BROADCAST_ROWS = 1 << 18
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, words: int) -> None:
        self.words = words

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space is \x20 and \x09 to \x0d
        n, k = len(words), self.words
        if not n:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)  # quicker than a memo
        k = min(n, k)
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * C2 + hashes[i : n - k + 1 + i])
        out.sort()
        first = np.ones(len(out), bool)
        np.not_equal(out[1:], out[:-1], out=first[1:])
        return out[first]


def minhashes(shingles: np.ndarray, count: int) -> np.ndarray:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[None, at : at + (1 << 14)]
        np.minimum(out, ((part ^ seeds[:count, None]) * (seeds[count:, None] | np.uint64(1))).min(1), out=out)
    return out


def collections(shingles: np.ndarray, half: int = HALF, rows: int = ROWS) -> tuple[list[int], list[int]]:
    """The keys of A and of B."""
    keys = np.zeros(2 * half, np.uint64)
    for column in minhashes(shingles, 2 * half * rows).reshape(2 * half, rows).T:
        keys = mix(keys * C1 + column)
    keys = keys.view(np.int64).tolist()
    return keys[:half], keys[half:]


def signatures(docs: DataFrame, words: int, half: int, rows: int) -> DataFrame:
    """id, n (size of the shingle set), digest of the set, a, b (null for an empty set)."""

    def start():
        shingler = Shingler(words)

        def apply(batch):
            out: dict[str, list] = {"n": [], "digest": [], "a": [], "b": []}
            for text in batch.column(1).to_pylist():
                s = shingler.of(text)
                a, b = collections(s, half, rows) if len(s) else (None, None)
                out["n"].append(len(s))
                out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["a"].append(a)
                out["b"].append(b)
            return {"id": batch.column(0)} | out

        return apply

    return map_batches(docs.select("doc_id", "text"), start, "id long, n long, digest binary, a array<long>, b array<long>")


def buckets(members: DataFrame) -> DataFrame:
    """Representatives to (key, id, weight, size), of the buckets with two members or more, one of those with equal members."""
    left = members.filter("id = rep AND a IS NOT NULL").select("id", "b", F.posexplode("a").alias("i", "x")).select("id", "b", F.xxhash64("i", "x").alias("ha"))
    shared = left.groupBy("ha").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("ha")
    keys = left.join(shared, "ha").select("id", "ha", F.posexplode("b").alias("j", "y")).select("id", F.xxhash64("ha", "j", "y").alias("key"))
    keys = materialize(keys)
    sums = keys.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1))).alias("sign")).filter("size > 1")
    chosen = materialize(sums.groupBy("low", "size", "sign").agg(F.min("key").alias("key")).select("key", "size"))
    found = materialize(keys.join(chosen, "key"))
    weights = materialize(found.groupBy("id").agg(F.sum("size").alias("weight")))
    return materialize(found.join(weights, "id"))


def heaviest(rows: DataFrame, *by: str) -> DataFrame:
    """Of each group the weight and id (v) of the heaviest member, of equals the smallest id."""
    return rows.groupBy(*by).agg(F.max("weight").alias("top"), F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("m")).select(*by, "top", (-F.col("m.id")).alias("v"))


def ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def verify(pairs: DataFrame, docs: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """Of ``pairs`` (u, v) those with ``least[1]`` * intersection >= ``least[0]`` * union of the full shingle sets."""
    texts = docs.select("doc_id", "text")
    if pairs.count() <= BROADCAST_ROWS:
        first = texts.join(F.broadcast(pairs), texts["doc_id"] == pairs["u"]).select("u", "v", F.col("text").alias("s"))
        second = texts.join(F.broadcast(pairs.select("v").distinct()), texts["doc_id"] == F.col("v")).select("v", F.col("text").alias("t"))
        both = first.join(second, "v").select("u", "v", "s", "t")
    else:
        wanted = materialize(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct())
        texts = materialize(texts.join(sent_to_all(wanted), "doc_id", "left_semi"))  # the others are neither shuffled nor sorted
        first = pairs.join(texts, texts["doc_id"] == pairs["u"]).select("u", "v", F.col("text").alias("s"))
        both = first.join(texts, texts["doc_id"] == F.col("v")).select("u", "v", "s", F.col("text").alias("t"))

    def start():
        shingler, kept = Shingler(words), OrderedDict()

        def of(doc: int, text: str) -> np.ndarray:
            known = kept.get(doc)
            if known is None or known[0] != text:
                known = kept[doc] = (text, shingler.of(text))
                if len(kept) > 64:
                    kept.popitem(last=False)
            else:
                kept.move_to_end(doc)
            return known[1]

        def apply(batch):
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: dict[str, list] = {"u": [], "v": []}
            for u, v, s, t in zip(us, vs, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = of(u, s), of(v, t)
                if min(len(x), len(y)) * least[1] < max(len(x), len(y)) * least[0] or not len(x):
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                if least[1] * common >= least[0] * (len(x) + len(y) - common):
                    out["u"].append(u)
                    out["v"].append(v)
            return out

        return apply

    return map_batches(both, start, "u long, v long")


def unresolved(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, id, size, root) of the buckets that have several components."""
    each = found.groupBy("id").agg(F.collect_list(F.struct("key", "size")).alias("in"))  # at most one for each table
    rooted = each.join(roots.select(F.col("u").alias("id"), F.col("v").alias("found")), "id", "left").select("id", F.coalesce("found", "id").alias("root"), F.inline("in"))
    rooted = materialize(rooted)
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    return materialize(rooted.join(several, "key"))


def common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets ``xs`` has in common with each of ``ys``."""
    out = np.zeros((len(xs), len(ys)), np.float32)  # whole numbers below 2^24 are exact
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (xs, ys)]
    both = np.intersect1d(*(tokens for tokens, _ in sides))
    if not len(both):
        return out
    places = []
    for tokens, rows in sides:
        at = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
        here = both[at] == tokens
        order = np.argsort(at[here], kind="stable")
        places.append((at[here][order], rows[here][order]))
    (p, a), (q, b) = places
    m, n = np.bincount(p, minlength=len(both)), np.bincount(q, minlength=len(both))
    rare = m * n <= max(1, out.size >> 9)
    # rare shingles pair by pair
    start, other, each = np.cumsum(m) - m, np.cumsum(n) - n, np.where(rare, m * n, 0)
    for low in range(0, len(both), COLUMNS):
        part = slice(low, low + COLUMNS)
        k = np.repeat(np.arange(len(both))[part], each[part])
        off = np.arange(len(k)) - np.repeat(np.cumsum(each[part]) - each[part], each[part])
        np.add.at(out, (a[start[k] + off // n[k]], b[other[k] + off % n[k]]), 1)
    # the others as columns of matrices
    column = np.cumsum(~rare) - 1
    for low in range(0, int((~rare).sum()), COLUMNS):
        mats = []
        for at, rows, size in ((p, a, len(xs)), (q, b, len(ys))):
            c = column[at] - low
            here = ~rare[at] & (c >= 0) & (c < COLUMNS)
            mat = np.zeros((size, COLUMNS), np.float32)
            mat[rows[here], c[here]] = 1
            mats.append(mat)
        out += mats[0] @ mats[1].T
    return out


def joining(xs: list[tuple], ys: list[tuple], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Of the links between members (id, root, set) of ``xs`` and of ``ys`` enough to join all roots that they join."""
    sizes = [np.array([len(s) for _, _, s in side], np.int64) for side in (xs, ys)]
    shared = common([s for _, _, s in xs], [s for _, _, s in ys]).astype(np.int64)
    linked = least[1] * shared >= least[0] * (sizes[0][:, None] + sizes[1][None, :] - shared)
    linked &= np.array([r for _, r, _ in xs])[:, None] != np.array([r for _, r, _ in ys])[None, :]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for i, j in zip(*(at.tolist() for at in np.nonzero(linked)), strict=True):
        r, q = find(xs[i][1]), find(ys[j][1])
        if r != q:
            parent[r] = q
            out.append((max(xs[i][0], ys[j][0]), min(xs[i][0], ys[j][0])))
    return out


def within_families(large: DataFrame, members: DataFrame, docs: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """Links (u, v) that join all components which any link between members of one family joins. ``large``: key, id, root."""
    heads = large.groupBy("key").agg(F.min("id").alias("head"))
    family = components(large.join(heads, "key").select(F.col("id").alias("u"), F.col("head").alias("v")))
    sizes = members.groupBy("id").agg(F.sum(F.col("n") + MEMBER).alias("n"))
    rows = large.select("id", "root").distinct().join(family.select(F.col("u").alias("id"), F.col("v").alias("f")), "id", "left").join(sizes, "id")
    rows = materialize(rows.select("id", "root", "n", F.coalesce("f", "id").alias("family")))
    parts = rows.groupBy("family", "root").agg(F.sum("n").alias("n"))
    owner = F.when(F.col("n") > BLOCK, F.col("root"))  # null: small components share blocks
    owners = parts.groupBy("family", owner.alias("owner")).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high"))
    plan = owners.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("owner", "blocks"))).alias("o"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
    first = lambda i: F.aggregate(F.slice("o", 1, i), F.lit(0), lambda s, x: s + x["blocks"])
    plan = plan.select("family", F.transform("o", lambda x, i: F.struct(x["owner"].alias("owner"), x["blocks"].alias("blocks"), first(i).alias("first"))).alias("o"))
    dealt = rows.join(plan, "family")
    large_one = F.exists("o", lambda x: x["owner"].eqNullSafe(F.col("root")))
    dealt = dealt.withColumn("mine", F.element_at(F.filter("o", lambda x: x["owner"].eqNullSafe(F.when(large_one, F.col("root")))), 1))
    block = (F.col("mine.first") + F.pmod(F.xxhash64("id", F.lit(5)), F.col("mine.blocks"))).cast("int").alias("block")
    others = F.flatten(F.transform(F.filter("o", lambda x: x["owner"].isNull() | ~x["owner"].eqNullSafe(F.col("mine.owner"))), lambda x: F.sequence(x["first"], x["first"] + x["blocks"] - 1)))
    dealt = materialize(dealt.select("id", "root", "family", block, others.alias("others")))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    known = texts.join(F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt, "id")
    sent = known.select("id", "root", "family", "block", "text", F.explode("others").alias("other")).select("id", "root", "block", "text", "family", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def decide(group: pa.Table) -> pa.Table:
        shingler, sides = Shingler(words), {}
        for i, root, block, text in zip(*(group.column(c).to_pylist() for c in ("id", "root", "block", "text")), strict=True):
            if len(s := shingler.of(text)):
                sides.setdefault(block, []).append((i, root, s))
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        found = joining(sides[x], sides[y], least) if x in sides and y in sides else []
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return sent.groupBy("family", "x", "y").applyInArrow(decide, "u long, v long")


def near_dedup(docs: DataFrame, words: int = 5, least: tuple[int, int] = (80, 100), half: int = HALF, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``least`` is the Jaccard similarity, from which on documents are linked, as a fraction. A text of
    fewer words than a shingle has one shingle of all of them; a null text or one without words has none
    and is linked with nothing. Rows that share a doc_id count as one document, linked with whatever
    one of them is linked with. A null doc_id stands alone, with a null component, and is kept. An
    empty table gives no rows; further columns are ignored.
    """
    known = materialize(signatures(docs, words, half, rows))
    classes = materialize(known.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep")))
    members = materialize(known.join(classes, "digest", "left").select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("a")).alias("a"), F.when(F.col("id") == F.col("rep"), F.col("b")).alias("b")))
    found = buckets(members)
    asked = materialize(found.join(heaviest(found, "key"), "key").filter("id <> v").select(*ordered("id", "v")).distinct())
    links = materialize(verify(asked, docs, words, least))
    roots = components(links)
    left = unresolved(found.filter("size > 2"), roots)
    small, large = left.filter(F.col("size") <= SMALL), left.filter(F.col("size") > SMALL)
    pairs = small.select("key", F.col("id").alias("u"), F.col("root").alias("r")).join(small.select("key", F.col("id").alias("v"), F.col("root").alias("q")), "key").filter("u > v AND r <> q").select("u", "v")
    more = materialize(verify(materialize(pairs.distinct().join(asked, ["u", "v"], "left_anti")), docs, words, least))
    if not large.isEmpty():
        more = more.unionByName(materialize(within_families(large, members, docs, words, least)))
    if not more.isEmpty():
        links = materialize(links.unionByName(more))
        roots = components(links)
    of_rep = roots.select(F.col("u").alias("rep"), F.col("v").alias("root"))
    # an id with several texts can have several representatives: the classes then hang together by it
    ids = members.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("c"))
    torn = ids.filter("c > 1 OR low <> high")
    if not torn.isEmpty():
        more = members.filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
        roots = components(links.unionByName(more))
        of_rep = roots.select(F.col("u").alias("rep"), F.col("v").alias("root"))
        members = members.withColumn("rep", F.coalesce("id", "rep"))
    out = members.select("id", "n", "rep").join(of_rep, "rep", "left").select("id", "n", F.coalesce("root", "rep", "id").alias("root"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.col("id").eqNullSafe(F.col("root")).alias("kept"))
