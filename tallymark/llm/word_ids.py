"""Token ids of whole texts with a bounded cache of words, for use inside tasks.

Texts are cut into pre-tokens with numpy; only words that the cache lacks go to the tokenizer, as
words, once per batch. The cache is a table of fixed size that a later word may overwrite. Words are
told apart by two hashes (128 bits).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tallymark.llm.spans import code_points, distinct_spans, pre_tokens, ragged, span_hashes

WIDTH = 8


class WordIds:
    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bits: int = 20):
        self.encode, self.mask = encode, np.uint64((1 << bits) - 1)
        self.keys, self.checks = np.zeros((2, 1 << bits), np.uint64)
        self.counts = np.zeros(1 << bits, np.int8)
        self.ids = np.zeros((1 << bits) * WIDTH, np.uint16)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, joined, and the number of ids of each text."""
        joined, units, text_starts = code_points(texts)
        starts, ends = pre_tokens(units, text_starts)
        hashes, checks = (span_hashes(units, starts, ends, lane) for lane in (0, 1))
        slots = (hashes & self.mask).astype(np.int64)
        known = (self.keys[slots] == hashes) & (self.checks[slots] == checks) & (self.counts[slots] > 0)
        missing = np.flatnonzero(~known)
        _, first, which = distinct_spans(units, starts[missing], ends[missing])
        place = missing[first]
        fresh = self.encode([joined[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist())])
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        flat = np.fromiter((i for w in fresh for i in w), np.uint32, int(lengths.sum()))
        offsets = np.concatenate([[0], np.cumsum(lengths)])

        counts = np.empty(len(hashes), np.int64)
        counts[known], counts[missing] = self.counts[slots[known]], lengths[which]
        total = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(total[-1]), np.uint32)
        within = np.arange(len(out)) - np.repeat(total[:-1], counts)
        of_known = np.repeat(known, counts)
        base = np.repeat(slots * WIDTH, np.where(known, counts, 0))
        out[of_known] = self.ids[base + within[of_known]]
        out[~of_known], _ = ragged(flat, offsets, which)

        small = np.flatnonzero((lengths <= WIDTH) & (lengths > 0))
        if len(flat) and flat.max() > 0xFFFF:
            small = small[:0]
        slot = (hashes[place[small]] & self.mask).astype(np.int64)
        _, last = np.unique(slot, return_index=True)
        slot, small = slot[last], small[last]
        self.keys[slot], self.checks[slot] = hashes[place[small]], checks[place[small]]
        self.counts[slot] = lengths[small]
        values, sizes = ragged(flat, offsets, small)
        at = np.repeat(slot * WIDTH, sizes) + np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.ids[at] = values
        edges = total[np.searchsorted(starts, text_starts)]
        return out, np.diff(edges)
