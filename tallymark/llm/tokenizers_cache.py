"""One tokenizer and word cache for each worker process."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from tallymark.llm.bpe import byte_letters
from tallymark.llm.word_ids import WordIds


def largest_id(tokenizer_json: str) -> int:
    """The largest id that the vocabulary or its added tokens can give."""
    model = json.loads(tokenizer_json)
    return max([0, *model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens") or ())])


class TextIds:
    """Ids of whole texts as the tokenizers library gives them without special tokens of its template: the
    literals of the file's added tokens have their own ids, wherever they stand, and what lies between
    them is cut into words apart. Words go straight to the tokenizer's model and are cached."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        added = json.loads(tokenizer_json).get("added_tokens") or []
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        model = Tokenizer.from_str(tokenizer_json).model
        letters = {b: c for c, b in byte_letters().items()}

        def encode(words: list[str]) -> list[list[int]]:
            return [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]

        self.words = WordIds(encode, bits=21)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, joined, and the number of ids of each text."""
        if not self.cut or not any(c in t for t in texts for c in self.added):
            return self.words(texts)
        pieces = [self.cut.split(t) for t in texts]
        flat = [p for own in pieces for p in own]
        literal = np.array([i % 2 == 1 for own in pieces for i in range(len(own))])
        ids, counts = self.words(["" if x else p for p, x in zip(flat, literal.tolist())])
        places = (np.cumsum(counts) - counts)[literal]
        ids = np.insert(ids, places, np.array([self.added[p] for p, x in zip(flat, literal.tolist()) if x], ids.dtype))
        counts[literal] = 1
        ends = np.cumsum([len(own) for own in pieces])
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[np.concatenate([[0], ends])])


@lru_cache(maxsize=2)
def tokenizer_ids(tokenizer_json: str) -> TextIds:
    return TextIds(tokenizer_json)
