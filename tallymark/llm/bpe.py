"""Byte-level BPE of single pre-tokens: rank table and merging."""

from __future__ import annotations

import base64
import heapq
import json
from functools import cache

import numpy as np


def ranks_of(lines: bytes) -> dict[bytes, int]:
    """Rank table of a rank file (base64 token and rank in each line)."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


@cache
def byte_letters() -> dict[str, int]:
    """The public printable alphabet of byte-level vocabularies, as letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of_json(text: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int]]:
    """Ids of tokens and order of merges of a byte-level tokenizer file."""
    model, letters = json.loads(text)["model"], byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    ids = {raw(token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
    merges = {}
    for place, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[raw(left), raw(right)] = place
    return ids, merges


class Encoder:
    """Ids of one pre-token. Without ``merges`` the order of merging is the rank of the joined token."""

    def __init__(self, ids: dict[bytes, int], merges: dict[tuple[bytes, bytes], int] | None = None):
        self.ids, self.merges = ids, merges

    def _order(self, a: bytes, b: bytes) -> int | None:
        return self.ids.get(a + b) if self.merges is None else self.merges.get((a, b))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None and self.merges is None:
            return [whole]
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        n = len(parts)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        order = self._order
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := order(parts[i], parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if parts[i] is None or right[i] != j or j >= n or order(parts[i], parts[j]) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := order(parts[i], parts[k])) is not None:
                    heapq.heappush(heap, (r, i, k))
            h = left[i]
            if h >= 0 and (r := order(parts[h], parts[i])) is not None:
                heapq.heappush(heap, (r, h, i))
        return [self.ids[p] for p in parts if p is not None]


def token_bytes(ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes by id, and their offsets. Bounded by the vocabulary."""
    by_id = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        by_id[i] = token
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in by_id])])
    return np.frombuffer(b"".join(by_id), np.uint8), offsets
