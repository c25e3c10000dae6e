"""Whole texts as flat byte arrays: word spans, word hashes and shingle hashes of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_STEP = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_powers: dict[str, np.ndarray] = {}

#: [\x20\x09-\x0D]: white space that parts words.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        base = _B if kind == "up" else _B_INVERSE
        a = np.full(max(n, 1 << 16), base, np.uint64)
        a[0] = 1
        _powers[kind] = np.multiply.accumulate(a)
    return _powers[kind][:n]


def chunks(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """UTF-8 bytes of the texts (None: empty), in runs of about limit bytes: (position of the first, texts)."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t)
        if run and size + len(b) > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(b)
        size += len(b) + 1
    if run:
        yield start, run


def spans(texts: list[bytes], inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, A-Z lower-cased: (bytes, starts, ends, first word of each text and the end).

    inside: which bytes belong to words; by default all but SPACE. Texts stand in the bytes with one space between.
    """
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    word = ~SPACE[buf] if inside is None else inside[buf]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return buf, starts, ends, np.searchsorted(starts, at)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    n = len(buf)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power("up", n), dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * _power("down", n)[starts] + (ends - starts).astype(np.uint64))


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted set of each text's word shingles, as hashes; a text with fewer words has them all as one."""
    buf, starts, ends, first = spans(texts)
    h = word_hashes(buf, starts, ends)
    n = max(0, len(h) - size + 1)
    roll = h[:n].copy()
    for k in range(1, size):
        roll = mix(roll * _STEP[k % 3] + h[k : k + n])
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(roll[lo : hi - size + 1]))
        elif hi > lo:
            x = np.array([hi - lo], np.uint64)
            for w in h[lo:hi, None]:
                x = mix(x * _STEP[0] + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
