"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The byte spans of its tokens and of its sections are two
sorted lists of intervals, joined by binary search. A token inside one section counts there; one that
crosses a boundary goes to the section holding most of its bytes, of equals to the earliest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ._common import map_batches, texts_of
from .bpe import read_ranks, vocabulary


def line_ends(data: bytes) -> np.ndarray:
    """Sections are lines: the offsets behind each line feed, and the end."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those cross a boundary. Both lists tile [0, last end)."""
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    crossing = np.flatnonzero(first != last)
    owner = first.copy()
    for i in crossing.tolist():
        cuts = np.concatenate(([starts[i]], section_ends[first[i] : last[i]], [token_ends[i]]))
        owner[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=len(section_ends)), np.bincount(owner[crossing], minlength=len(section_ends))


def token_counts(docs: DataFrame, path: str, pattern: str, sections: Callable[[bytes], np.ndarray] = line_ends) -> DataFrame:
    """One row a section: doc_id, section (from 0), start_char, end_char, n_tokens, n_crossing, doc_tokens.

    ``sections`` maps the UTF-8 bytes of a text to the ends of its sections (lines, unless told
    otherwise); spans are reported in code points. The counts of a document's sections add up to
    doc_tokens. An empty or null text has one empty section with no tokens. Rows are treated each by
    itself: repeated ones give repeated results, an empty table none. Further columns are ignored.
    """
    data = vocabulary(docs.sparkSession, path)

    def start():
        import tiktoken

        ranks = read_ranks(data.value)
        coder = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, v in ranks.items():
            size[v] = len(k)

        def apply(batch):
            names = ("doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens")
            out: dict[str, list] = {k: [] for k in names}
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                raw = text.encode()
                ends = sections(raw)
                ids = np.array(coder.encode_ordinary(text), np.int64)
                counts, crossing = attribute(np.cumsum(size[ids]), ends)
                chars = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)))
                stops = chars[ends].tolist()
                out["doc_id"] += [doc] * len(stops)
                out["section"] += range(len(stops))
                out["start_char"] += [0, *stops[:-1]]
                out["end_char"] += stops
                out["n_tokens"] += counts.tolist()
                out["n_crossing"] += crossing.tolist()
                out["doc_tokens"] += [len(ids)] * len(stops)
            return out

        return apply

    return map_batches(docs.select("doc_id", "text"), start, "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long")
