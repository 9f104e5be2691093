"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A tokenisation is the BPE result exactly if each adjacent pair of its tokens is the BPE result of its
own bytes. So for every prefix of a word there is one valid last token, found among the suffixes of
the prefix. The transducer reads bytes; its state is the last token emitted and the bytes not yet
settled. A token is emitted as soon as it lies on the path of every position from which a token can
still be open; since no token is longer than the longest of the vocabulary, that takes a bounded
lookahead. States and transitions are made when first met and kept in tables.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import map_batches, texts_of

#: Entries after which a worker's memo of words and table of states start anew.
MEMO, STATES = 1 << 19, 1 << 18
#: Longer matches of the pattern are not kept in the memo, so it is bounded in bytes, too.
LONGEST = 256
#: Ids that are decoded at a time.
STEP = 1 << 12


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A vocabulary in the tiktoken format: base64 bytes and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_bytes(word: bytes, ranks: dict[bytes, int], least: int = 1) -> list[int]:
    """BPE by its definition: join the adjacent pair of the lowest rank, leftmost first, until none or ``least`` parts are left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > least:
        best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Words in, token ids out.

    A state is the last token emitted and, for each position from which a token may still be open
    (the last always is), the trie node of the bytes since and the unsettled tokens that lead there.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.trie: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                self.inner[node] = True
                to = self.trie.get(node << 8 | byte)
                if to is None:
                    to = self.trie[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            self.token[node] = rank
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (-1, ((0, ()),))
        self.ids: dict[tuple, int] = {start: 0}
        self.states: list[tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]] = [start]
        self.next: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token``; a byte is its own halves."""
        known = self.parts.get(token)
        if known is None:
            word = self.bytes_of[token]
            if len(word) == 1:
                known = (token, token)
            else:
                known = tuple(merge_bytes(word, self.ranks, 2))
            self.parts[token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE of both tokens' bytes gives these two."""
        if left < 0:
            return True
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > STATES * 2:
                self.pairs.clear()
            known = self.pairs[key] = self.unmerged(left, right)
        return known

    def unmerged(self, left: int, right: int) -> bool:
        """Undo merges from the latest on, looking for an earlier one across the border."""
        ranks, bytes_of, limit = self.ranks, self.bytes_of, 1 << 60
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], 1 << 60) < limit:
                return False
            if left > right:
                limit, left = left, self.halves(left)[1]
                if left == limit:
                    limit, right = right + 1, self.halves(right)[0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.halves(right)[0]
                if right + 1 == limit:
                    limit, left = left, self.halves(left)[1]
                    if left == limit:
                        return True

    def grow(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition of ``state`` on ``byte``."""
        before, live = self.states[state]
        whole, still = None, []
        for node, path in live:
            to = self.trie.get(node << 8 | byte)
            if to is not None:
                if whole is None and (token := self.token[to]) >= 0 and self.fits(path[-1] if path else before, token):
                    whole = (*path, token)
                if self.inner[to]:
                    still.append((to, path))
        if whole is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        emit: tuple[int, ...] = ()
        if not still:
            emit, before, live = whole, whole[-1], ((0, ()),)
        else:
            still.append((0, whole))
            settled = 0
            for token in still[0][1]:
                if any(len(path) <= settled or path[settled] != token for _, path in still):
                    break
                settled += 1
            if settled:
                emit, before, still = whole[:settled], whole[settled - 1], [(node, path[settled:]) for node, path in still]
            live = tuple(still)
        to = self.ids.get((before, live))
        if to is None:
            to = self.ids[before, live] = len(self.states)
            self.states.append((before, live))
            self.next.append({})
        step = self.next[state][byte] = (to, emit)
        return step

    def encode(self, word: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self.reset()
        state, out, tables = 0, [], self.next
        for byte in word:
            state, emitted = tables[state].get(byte) or self.grow(state, byte)
            if emitted:
                out += emitted
        out += self.states[state][1][-1][1]
        return out


#: Lead bytes to (continuation bytes, lowest and highest first one).
LEADS = (
    {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
    | {b: (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) for b in range(0xE0, 0xF0)}
    | {b: (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) for b in range(0xF0, 0xF5)}
)


class Utf8Stream:
    """Text out of bytes that arrive in any pieces.

    A state machine over lead and continuation bytes, whose state is the character begun: at most three
    bytes that may still become one. Whole characters leave at once. Bytes that can't continue a
    character give one U+FFFD for each maximal ill-formed part.
    """

    def __init__(self) -> None:
        self.begun = b""

    @staticmethod
    def state_after(data: bytes) -> int:
        """How many bytes at the end of ``data`` are a character begun. A lead byte starts anew in any state, so the last one tells."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if 0x80 <= b <= 0xBF:
                continue
            need, low, high = LEADS.get(b, (0, 0, 0))
            return k if need >= k and (k == 1 or low <= data[1 - k] <= high) else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.begun + data if self.begun else data
        end = len(data) - self.state_after(data)
        self.begun = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        left, self.begun = self.begun, b""
        return left.decode("utf-8", "replace")


class Encoder(dict):
    """Whole texts to little-endian unsigned 32-bit ids; a memo of words in front of the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.machine, self.find = Transducer(ranks), regex.compile(pattern).findall
        size = max(ranks.values(), default=0) + 1
        self.table = [b""] * size
        for k, v in ranks.items():
            self.table[v] = k
        self.sizes = np.array([len(x) for x in self.table], np.int64)
        self.flat, self.starts = np.frombuffer(b"".join(self.table), np.uint8), np.cumsum(self.sizes) - self.sizes

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = np.array(self.machine.encode(word.encode()), "<u4").tobytes()
        if len(word) <= LONGEST:
            self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids, ill-formed or not."""
        ids = np.frombuffer(ids, "<u4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + sizes, sizes)].tobytes()

    def stream(self, ids: bytes, step: int = STEP) -> Iterator[str]:
        """The text of ``ids`` in pieces, as it leaves the incremental UTF-8 machine after every ``step`` ids."""
        machine = Utf8Stream()
        for at in range(0, len(ids), 4 * step):
            yield machine.feed(self.decode(ids[at : at + 4 * step]))
        yield machine.close()


def vocabulary(spark: SparkSession, path: str):
    """The ranks of a vocabulary file of the driver, sent to each executor once (a file of fixed size, about 1 MB)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@contextlib.contextmanager
def no_collection():
    """Without the collector of cycles: the tables grow by millions of tuples, hold no cycles, and would be walked again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


_ready: dict[tuple, Encoder] = {}


def encoder_of(data: bytes, pattern: str) -> Encoder:
    """The worker's encoder, kept from task to task for the last vocabulary used."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Encoder(read_ranks(data), pattern)
    return _ready[key]


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """Encode each whole text and decode it again: doc_id and the columns named in ``keep``, of

    ids (binary, little-endian unsigned 32-bit), n_tokens, ids_sha256, decoded (binary), decoded_sha256.
    Decoding goes through the incremental UTF-8 machine; the ids of a text being well-formed together,
    its text in UTF-8 is the bytes of the ids.

    Null text counts as empty: no ids, hashes of nothing. Each row is treated by itself, so repeated
    rows and ids give repeated results, and an empty table an empty one. Further columns are ignored.
    """
    data = vocabulary(docs.sparkSession, path)
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "binary", "decoded": "binary"}

    def start():
        encoder = encoder_of(data.value, pattern)

        def apply(batch):
            out = {"doc_id": batch.column(0)} | {k: [] for k in keep}
            with no_collection():
                for text in texts_of(batch):
                    ids = encoder.ids(text)
                    decoded = "".join(encoder.stream(ids)).encode()
                    row = {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(decoded).hexdigest(), "ids": ids, "decoded": decoded}
                    for k in keep:
                        out[k].append(row[k])
            return out

        return apply

    return map_batches(docs.select("doc_id", "text"), start, "doc_id long, " + ", ".join(f"{k} {kinds[k]}" for k in keep))


def decode_tokens(encoded: DataFrame, path: str, step: int = STEP) -> DataFrame:
    """``encoded`` (doc_id, ids) to doc_id, text: ids are fed ``step`` at a time to the incremental UTF-8 machine. Null ids give an empty text."""
    data = vocabulary(encoded.sparkSession, path)

    def start():
        encoder = Encoder(read_ranks(data.value), "")

        def apply(batch):
            return {"doc_id": batch.column(0), "text": ["".join(encoder.stream(ids or b"", step)) for ids in batch.column(1).to_pylist()]}

        return apply

    return map_batches(encoded.select("doc_id", "ids"), start, "doc_id long, text string")
