"""Words and shingles of whole texts as 64-bit hashes, in numpy.

A word's hash is a polynomial over a random table of byte values, modulo 2**64, read from prefix
sums over a buffer of many texts; it is then mixed. Buffers are bounded, so a very long text is
hashed in segments that end between words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: \x20 and \x09-\x0D part words; every other byte belongs to one.
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: For word features: ASCII letters, digits and all bytes of longer characters belong to words.
NOT_WORD = ~np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
SEGMENT = 1 << 20

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_TERMS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        n = max(n, SEGMENT + 4096)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _hashed(buffer: bytes, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and end bytes of the words of a buffer."""
    return _summed(buffer, parting)[:3]


def _summed(buffer: bytes, parting: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes, first and end bytes of the words; prefix sums and the factors that bring them to one scale."""
    a = np.frombuffer(buffer, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~parting[a]
    edge = np.diff(inside)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
    return mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)), first, end, sums, down


def _segments(data: bytes, parting: np.ndarray) -> Iterator[bytes]:
    """A text in segments that end between words; a word longer than a segment stays whole."""
    at = 0
    while at < len(data):
        to = min(len(data), at + SEGMENT)
        if to < len(data):
            cut = np.flatnonzero(parting[np.frombuffer(data, np.uint8, to - at, at)])
            while not len(cut) and to < len(data):
                more = min(len(data), to + SEGMENT)
                cut = np.flatnonzero(parting[np.frombuffer(data, np.uint8, more - to, to)]) + (to - at)
                to = more
            if len(cut) and to < len(data) or len(cut) and not parting[data[to - 1]]:
                to = at + int(cut[-1]) + 1
        yield data[at:to]
        at = to


def _long(data: bytes, parting: np.ndarray) -> np.ndarray:
    """The words of one text, segment by segment."""
    out = [_hashed(s, parting)[0] for s in _segments(data, parting)]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def subwords(text: bytes, parting: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words of a text, and of the beginnings of those that are longer than `lengths` bytes."""
    out = []
    for segment in _segments(text, parting):
        whole, first, end, sums, down = _summed(segment, parting)
        out.append(whole)
        for n in lengths:
            at = first[end - first > n]
            out.append(mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n), 11))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def words(texts: Iterable[bytes], parting: np.ndarray = SPACES) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order of the texts."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        ends = np.cumsum([len(g) + 1 for g in group])
        hashes, first, _ = _hashed(b"\n".join(group), parting)
        yield from np.split(hashes, np.searchsorted(first, ends[:-1]))

    for t in texts:
        if group and size + len(t) > SEGMENT:
            yield from flush()
            group, size = [], 0
        if len(t) > SEGMENT:
            yield _long(t, parting)
            continue
        group.append(t)
        size += len(t) + 1
    if group:
        yield from flush()


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; of the whole text if it has fewer; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    if n < k:
        out = mix((hashes * _TERMS[:n]).sum(keepdims=True, dtype=np.uint64), 1000 + n)
    else:
        out = hashes[: n - k + 1] * _TERMS[0]
        for i in range(1, k):
            out = out + hashes[i : n - k + 1 + i] * _TERMS[i]
        out = mix(out, k)
    out = np.sort(out)
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def digest(values: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that are equal for equal sets."""
    return mix(values, 7).sum(dtype=np.uint64), mix(values, 8).sum(dtype=np.uint64)


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with A-Z lowered and nothing else changed. Lone surrogates can't occur in Spark strings."""
    return (text or "").encode("utf-8", "surrogatepass").lower()
