"""Vectorised splitting and hashing of texts with numpy, for use inside tasks.

A batch of texts becomes one array of code points (or bytes) with one gap after each text, so
that runs and windows never reach from one text into the next.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PRIME = (1 << 31) - 1
_BASES = (1_299_709_821, 774_236_053, 2_038_074_743, 911_382_323)
LONG = 256
SPACE, LETTER, NUMBER, OTHER, GAP = range(5)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finisher of splitmix64)."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@cache
def _powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo the prime."""
    out = []
    for factor in (base, pow(base, -1, _PRIME)):
        p = np.ones(1 << bits, np.uint64)
        for b in range(bits):
            p[1 << b : 2 << b] = _folded(p[: 1 << b] * np.uint64(pow(factor, 1 << b, _PRIME)))
        out.append(p)
    return out[0], out[1]


@cache
def _buffers() -> list[np.ndarray]:
    return [np.zeros((3, 1 << 19), np.uint64)]


def _scratch(n: int) -> np.ndarray:
    """Working rows of ``n`` numbers, reused from call to call; long ones are not kept."""
    kept = _buffers()
    return kept[0][:, :n] if n <= kept[0].shape[1] else np.zeros((3, n), np.uint64)


def _folded(x: np.ndarray) -> np.ndarray:
    """Remainders modulo 2**31 - 1."""
    prime, bits = np.uint64(_PRIME), np.uint64(31)
    x = (x & prime) + (x >> bits)
    x = (x & prime) + (x >> bits)
    return np.where(x >= prime, x - prime, x)


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of units[start:end] (units below 2**21). ``lane`` picks one of two independent hashes.

    Short spans: two polynomials modulo a prime, each with a base of its own, from prefix sums. Two
    different spans of up to ``LONG`` units share both values for at most LONG**2 of the 2**62 pairs of
    bases; a modulus of 2**64, which no base makes safe, is avoided. Longer spans: xxh3 of their units.
    """
    n, prime, bits = len(units), np.uint64(_PRIME), np.uint64(31)
    out = np.zeros(len(starts), np.uint64)
    work = _scratch(n + 1)
    own, term, high = work[0, :n], work[1, 1:], work[2, :n]
    own[:] = units
    own += np.uint64(1)
    for k, base in enumerate(_BASES[2 * lane : 2 * lane + 2]):
        power, inverse = _powers(max(16, int(n).bit_length()), base)
        np.multiply(own, power[:n], out=term)
        np.right_shift(term, bits, out=high)
        np.bitwise_and(term, prime, out=term)
        np.add(term, high, out=term)
        sums = work[1]
        sums[0] = 0
        np.cumsum(sums, out=sums)
        value = _folded(_folded(sums[ends] - sums[starts]) * inverse[starts])
        out |= value << np.uint64(31 * k)
    out = mix(out ^ (ends - starts).astype(np.uint64) << np.uint64(56))
    wide = np.flatnonzero(ends - starts > LONG)
    if len(wide):
        import xxhash

        out[wide] = [
            xxhash.xxh3_64_intdigest(units[a:b].tobytes(), seed=lane)
            for a, b in zip(starts[wide].tolist(), ends[wide].tolist())
        ]
    return out


def distinct_spans(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first place of every different span, and which of them each span is. Spans are told
    apart by both lanes (128 bits)."""
    hashes, checks = (span_hashes(units, starts, ends, lane) for lane in (0, 1))
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    odd = checks != checks[first][which]
    if not odd.any():
        return distinct, first, which
    pairs = np.stack([hashes, checks], 1)
    pairs, first, which = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
    return pairs[:, 0], first, which.ravel()


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by one gap each, their code points, and the start of each text."""
    joined = "\n".join(texts) + "\n"
    units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return joined, units, np.concatenate([[0], np.cumsum(lengths)])


def utf8(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with one gap each, and the start of each text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    units = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return units, np.concatenate([[0], np.cumsum(lengths)])


@cache
def _classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def pre_tokens(units: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens that the public byte-level pattern makes.

    Runs of letters, numbers and other signs take one blank before them; of white space that is
    followed by something all but its last sign is one piece; a lone apostrophe that no blank
    precedes takes the endings s, t, re, ve, m, ll and d.
    """
    kind = _classes()[units]
    gaps = text_starts[1:] - 1
    kind[gaps] = GAP
    before = np.empty_like(kind)
    before[0], before[1:] = GAP, kind[:-1]
    after = np.empty_like(kind)
    after[-1], after[:-1] = GAP, kind[1:]
    blank_before = np.zeros(len(units), bool)
    blank_before[1:] = (units[:-1] == 32) & (before[1:] == SPACE)
    space = kind == SPACE
    start = np.where(
        space,
        (before != SPACE) | ((after != SPACE) & (after != GAP)),
        (kind != before) & ~blank_before,
    )
    start[gaps] = True
    lone = np.flatnonzero((units == 39) & start & (after == LETTER) & (kind == OTHER))
    if len(lone):
        pad = np.concatenate([units, np.zeros(3, np.uint32)])
        one, two = pad[lone + 1], pad[lone + 2]
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        short = np.isin(one, [ord(c) for c in "stmd"])
        hit = lone[long | short]
        end = hit + np.where(long[long | short], 3, 2)
        start[hit + 1] = False
        start[end[kind[end] == LETTER]] = True
    at = np.flatnonzero(start)
    own = kind[at] != GAP
    ends = np.append(at[1:], len(units))[own]
    return at[own], ends


def ragged(values: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``picks`` of a ragged table, joined, with their lengths."""
    lengths = np.diff(offsets)[picks]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(offsets[:-1][picks] - (ends - lengths), lengths)
    return values[shift + np.arange(total)], lengths
