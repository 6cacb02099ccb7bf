"""Words of many texts at once, as arrays: spans, hashes and shingles without a Python object per word."""

from __future__ import annotations

import re

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Tables of powers up to this length are kept for the next texts; a longer text's go with it.
_KEPT = 1 << 21


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    made = {}
    for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
        p = np.full(_KEPT if n <= _KEPT else n, base, np.uint64)
        p[0] = 1
        made[name] = np.multiply.accumulate(p)
    if n <= _KEPT:
        _POWERS.update(made)
    return made["up"][:n], made["down"][:n]


#: Bytes that are hashed together: 8-byte numbers stand for that many at a time, whatever a text's length.
PIECE = 1 << 18


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte spans start[i] to end[i], which follow each other. A span's hash
    doesn't depend on where it stands."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        z = max(a + 1, int(np.searchsorted(end, start[a] + PIECE, side="right")))
        first, last = start[a], end[z - 1]
        up, down = _powers(int(last - first))
        with np.errstate(over="ignore"):
            sums = np.empty(last - first + 1, np.uint64)
            sums[0] = 0
            np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64, out=sums[1:])
            at, to = start[a:z] - first, end[a:z] - first
            out[a:z] = mix((sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64))
        a = z
    return out


class Words:
    """Words are runs without space, \\t, \\n, \\v, \\f, \\r.

    data: the bytes of all texts, each followed by a line end. start, end: byte spans of the words.
    first: words first[i] to first[i+1] are of text i."""

    def __init__(self, texts: list[str | bytes]):
        raw = [raw_bytes(t) for t in texts]
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        white = _WHITE[self.data]
        before = np.concatenate([[True], white[:-1]])
        self.start = np.flatnonzero(~white & before)
        self.end = np.flatnonzero(white & ~before)
        self.byte = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.first = np.searchsorted(self.start, self.byte)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all runs of `size` words, offsets per text). A text of fewer words is one shingle of
        all its words; a text without words has none. Repeats are kept."""
        return _shingles(self.hashes(), self.first, size)


def shingles_of(texts: list[str | bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The same for any texts; one of over LONG bytes is split into words a piece at a time."""
    raw = [raw_bytes(t) for t in texts]
    hashes, counts = [np.zeros(0, np.uint64)], []
    for a, z in grouped(raw, LONG):
        if len(raw[a]) <= LONG:
            w = Words(raw[a:z])
            hashes.append(w.hashes())
            counts += np.diff(w.first).tolist()
            continue
        some = [Words([raw[a][b:c]]).hashes() for b, c in cuts(raw[a], LONG)]
        hashes += some
        counts.append(sum(map(len, some)))
    return _shingles(np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), size)


#: Texts of more bytes than this are not split into words whole.
LONG = 4 << 20


def _shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    step = lambda k: mix(np.uint64(k + 1) + h[k : len(h) - size + 1 + k])
    with np.errstate(over="ignore"):
        runs = max(0, len(h) - size + 1)
        s = np.zeros(runs, np.uint64)
        for k in range(size if runs else 0):
            s += step(k)
        s = mix(s)
        full = np.maximum(n - size + 1, 0)
        short = np.flatnonzero((n > 0) & (n < size))
        if len(n) == 1 and not len(short):
            return s, np.array([0, len(s)])
        count = full.copy()
        count[short] = 1
        offsets = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(offsets[-1], np.uint64)
        whole = np.flatnonzero(full)
        inside = np.arange(int(full.sum())) - np.repeat(np.cumsum(full[whole]) - full[whole], full[whole])
        out[np.repeat(offsets[whole], full[whole]) + inside] = s[np.repeat(first[whole], full[whole]) + inside]
        if len(short):
            place = np.arange(int(n[short].sum())) - np.repeat(np.cumsum(n[short]) - n[short], n[short])
            each = mix(h[np.repeat(first[short], n[short]) + place] + (place + 1).astype(np.uint64))
            out[offsets[short]] = mix(np.add.reduceat(each, np.cumsum(n[short]) - n[short]) + n[short].astype(np.uint64))
    return out, offsets


def raw_bytes(text: str | bytes) -> bytes:
    return text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def cuts(text: bytes, size: int):
    """Ranges of about `size` bytes that end before white space (a word that is longer stays whole)."""
    a = 0
    while a < len(text):
        z = len(text)
        if a + size < z:
            hit = _SPACE.search(text, a + size)
            z = hit.start() if hit else z
        yield a, z
        a = z


def grouped(texts: list[str | bytes], most: int = 1 << 20):
    """Index ranges of texts of about `most` characters or bytes together (one longer text alone)."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)
