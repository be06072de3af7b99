"""Tokens, packing and the pre-token splitter against the public libraries."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from tallymark.llm import bpe, bpe_words, packing, spans
from tallymark.llm.shared import tokenizer_path
from tallymark.llm.tokenizers_cache import tokenizer_ids

RANK_FILE = open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb").read()
MODEL = open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read()


def encoding():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANK_FILE), special_tokens={}
    )


def long_pairs():
    """Different words that a polynomial modulo 2**64 takes for equal."""
    out = []
    for n in (256, 1024, 4096):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        out += [word, word.translate({97: 98, 98: 97})]
    return out


def test_long_words_are_told_apart(spark):
    texts = long_pairs()
    own, model = encoding(), Tokenizer.from_str(MODEL)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = bpe_words.decode(bpe_words.encode(docs, RANK_FILE), RANK_FILE).collect()
    assert {r.doc_id: (list(r.ids), bytes(r.decoded).decode()) for r in rows} == {
        i: (own.encode_ordinary(t), t) for i, t in enumerate(texts)
    }
    ids, counts = tokenizer_ids(MODEL)(texts)
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_pre_tokens_are_those_of_the_pattern():
    rng, pattern = random.Random(3), regex.compile(public_tokenizers.PATTERN)
    signs = " \n\t' 　aestrvmld19é½Δ漢!?-’\x1c\x85​"
    for _ in range(200):
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(8)]
        joined, units, starts = spans.code_points(texts)
        a, b = spans.pre_tokens(units, starts)
        assert [joined[i:j] for i, j in zip(a, b)] == [w for t in texts for w in pattern.findall(t)]


def test_words_encode_as_the_library_does():
    encoder, own, rng = bpe.Encoder(bpe.ranks_of(RANK_FILE)), encoding(), random.Random(4)
    words = ["", "a", "the", " the", "é" * 50, "ab" * 400, "漢字"] + [
        "".join(rng.choices("etaoinshr", k=rng.randint(1, 20))) for _ in range(300)
    ]
    assert all(encoder.encode(w.encode()) == own.encode_ordinary(w) for w in words if w)


def test_encode_and_decode(spark, messy, no_rows):
    own = encoding()
    want = Counter((r.doc_id, tuple(own.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in messy.collect())
    for block in (50, 6_000_000):
        rows = bpe_words.decode(bpe_words.encode(messy, RANK_FILE, buckets=5, block_chars=block), RANK_FILE).collect()
        assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == want
    assert bpe_words.decode(bpe_words.encode(no_rows, RANK_FILE), RANK_FILE).count() == 0


def check_packing(rows, want, capacity):
    """Every id in exactly one piece, sequences gapless and full or a power of two."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    have = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    total = 0
    for (doc, tokens), pieces in docs.items():
        copies = [ids for d, ids in want if d == doc and len(ids) == tokens]
        total += len(copies)
        assert sum(r.length for r in pieces) == tokens * len(copies)
        for r in pieces:
            crcs = {zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes()) for i in copies}
            assert r.ids_crc32 in crcs
    assert total == len(want) and sum(have.values()) == len(rows)


def test_packing(spark, messy, no_rows):
    model = Tokenizer.from_str(MODEL)
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"a{end}b  {end}", f"{end}{end} {end}\n it's{end}'s", "<|endoftext|", *long_pairs()]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = messy.unionByName(more, allowMissingColumns=True)
    want = [(r.doc_id, model.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
    assert (101, [64, 220, 50256, 275, 0]) in want
    for rests, capacity in ((4, 1024), (100, 64)):
        check_packing(packing.pack(docs, MODEL, capacity=capacity, rests=rests).collect(), want, capacity)
    assert packing.pack(no_rows, MODEL).count() == 0


def test_assignment_balances_cost():
    rng = random.Random(6)
    lengths = [rng.randint(1, 900) for _ in range(400)]
    pieces, n = packing.assign(lengths, 1024)
    assert sum(p[2] for p in pieces) == sum(lengths) and n <= sum(lengths) // 1024 + 10
    cost = Counter()
    for _, _, take, s, _ in pieces:
        cost[s] += take + take * take / 1024
    full = [c for s, c in cost.items() if s < sum(lengths) // 1024]
    assert len(pieces) < 1.7 * len(lengths) and max(full) < 1.8 * sum(full) / len(full)
