"""Token ids of a public tokenizer file, by array operations over the bytes of many texts.

The word tokenizer's normaliser and splitter never join anything across white space. So a text is cut into
units: a chunk between white space whose letters are ASCII or À to ÿ is cut where the splitter cuts it
(runs of letters, single digits, runs of other marks, contractions), lower-cased on its bytes; any other
chunk is one unit, which goes to the tokenizer as it is. A bounded table by 64-bit hash has the ids of
units seen before; new ones get theirs from the merges of the model, applied to all of them at once.

A tokenizer file with another normaliser, splitter or model is asked for every whole text.
"""

from __future__ import annotations

import json

import numpy as np

from loom.llm.common import single_thread
from loom.llm.words import cuts, mix, raw_bytes, span_hashes

#: Units kept in a worker's table; beyond that the later half is dropped, which is the rarer one.
MOST_UNITS = 1 << 19
#: Longer units are not kept.
LONGEST = 64
#: Bytes that are cut into units together; longer texts are cut at white space.
PIECE = 1 << 20
#: What the array path stands for; a file that differs in any of it is used through its own encoder. Fixed values.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

_LOADED: dict[str, "UnitCache | WholeTexts"] = {}

SPACE, LETTER, DIGIT, MARK, WIDE = range(5)


def _classes() -> np.ndarray:
    t = np.full(256, WIDE, np.uint8)
    t[:128] = MARK
    t[[9, 10, 11, 12, 13, 32]] = SPACE
    t[ord("0") : ord("9") + 1] = DIGIT
    t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1] = LETTER
    return t


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def tokenizer(path: str) -> "UnitCache | WholeTexts":
    """One in each Python worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        _LOADED[path] = UnitCache(path, known) if as_assumed(known) else WholeTexts(path)
    return _LOADED[path]


def as_assumed(known: dict) -> bool:
    """Whether a tokenizer file is a lower-casing BPE over bytes with word ends and the splitter above."""
    model, normal, split = known["model"], known.get("normalizer") or {}, known.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers") or [{}]
    return (
        normal.get("normalizers") == NORMAL and len(steps) == 2
        and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("invert") is True and steps[0].get("behavior") == "Removed"
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("ignore_merges")
    )


class WholeTexts:
    """Any tokenizer file, text by text."""

    def __init__(self, path: str):
        single_thread()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)

    def encode(self, texts: list[str | bytes]) -> list[np.ndarray]:
        some = [t.decode("utf-8", "replace") if isinstance(t, bytes) else t for t in texts]
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]


class Table:
    """Unsigned 64-bit keys -> numbers, by open addressing; look-ups and insertions of whole arrays."""

    EMPTY = np.uint64(0)

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)
        self.last = (1 << bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys (none of them 0), -1 where there is none."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], -1)
        todo = np.flatnonzero((seen != keys) & (seen != self.EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.last
            seen = self.keys[slot[todo]]
            found = seen == keys[todo]
            out[todo[found]] = self.values[slot[todo[found]]]
            todo = todo[~found & (seen != self.EMPTY)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that differ and aren't there yet."""
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == self.EMPTY]
            _, first = np.unique(slot[free], return_index=True)  # of keys that meet in a slot the first one gets it
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.last


class Merges:
    """The merges of a byte-level BPE with word ends, applied to many units at once."""

    NEVER = np.int32(1 << 30)

    def __init__(self, model: dict):
        vocabulary = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.plain, self.final = (np.array([vocabulary[letter[b] + end] for b in range(256)], np.int32) for end in ("", "</w>"))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = np.uint64(max(vocabulary.values()) + 1)
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int32) for k in (0, 1))
        self.result = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.ranks = Table(19)
        self.ranks.add(self._key(left, right), np.arange(len(pairs), dtype=np.int32))

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) * self.size + right.astype(np.uint64) + np.uint64(1)

    def apply(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after the other, how many each has). Each round merges, in every unit, its
        pair of the lowest rank, wherever it stands."""
        n = end - start
        own = np.repeat(np.arange(len(n), dtype=np.int32), n)
        symbol = self.plain[data[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(own))]]
        symbol[np.cumsum(n) - 1] = self.final[data[end - 1]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(own):
            rank = np.full(len(own), self.NEVER)
            inner = np.flatnonzero(own[1:] == own[:-1])
            found = self.ranks.find(self._key(symbol[inner], symbol[inner + 1]))
            rank[inner] = np.where(found < 0, self.NEVER, found)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sizes = np.diff(np.append(first, len(own)))
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = best == self.NEVER
            if over.any():
                done.append((own[over], symbol[over]))
                own, symbol, rank, best = (x[~over] for x in (own, symbol, rank, best))
                if not len(own):
                    break
            at = np.flatnonzero(rank == best)
            if (np.diff(at) == 1).any():  # one symbol repeated: its pairs overlap, and from the left every other one is merged
                run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
                at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            symbol[at] = self.result[rank[at]]
            stay = np.ones(len(own), bool)
            stay[at + 1] = False
            own, symbol = own[stay], symbol[stay]
        if not done:
            return np.zeros(0, np.uint32), n
        own, symbol = (np.concatenate(x) for x in zip(*done))
        return symbol[np.argsort(own, kind="stable")].astype(np.uint32), np.bincount(own, minlength=len(n))


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, the plain chunks lower-cased; first byte of each unit; its end; whether it is for the tokenizer).

    data: texts that end with white space. See the module's docstring for what a unit is."""
    kind = _CLASS[data]
    # À to ÿ but for the two signs among them are letters of two bytes
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        follow = data[np.minimum(lead + 1, len(data) - 1)]
        lead, follow = (x[(follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)] for x in (lead, follow))
        kind[lead] = kind[lead + 1] = LETTER
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    kind[special] = WIDE  # perhaps a special token
    black = kind != SPACE
    edge = np.flatnonzero(np.diff(np.concatenate([[False], black]).astype(np.int8)))  # begins and ends of chunks, by turns
    begin, stop = edge[::2], edge[1::2]
    wide = np.flatnonzero(kind == WIDE)
    whole = np.zeros(len(begin), bool)
    if len(wide):
        whole[np.searchsorted(begin, wide, side="right") - 1] = True
        for a, z in zip(begin[whole], stop[whole]):
            kind[a:z] = WIDE
    lowered = _LOWER[data]
    if len(lead):
        up = (follow <= 0x9E) & (kind[lead] == LETTER)
        lowered[lead[up] + 1] = follow[up] + 32
    if whole.any():
        keep = kind == WIDE
        lowered[keep] = data[keep]
    # a unit begins where the kind changes, and at every digit
    new = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == DIGIT)
    # contractions: an apostrophe that begins a run of marks takes one or two letters with it
    quote = np.flatnonzero((lowered == ord("'")) & new & (kind == MARK))
    if len(quote):
        a, b = (lowered[np.minimum(quote + k, len(data) - 1)] for k in (1, 2))
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, n in ((quote[one], 1), (quote[two], 2)):
            new[hit + 1] = False
            after = hit + 1 + n
            new[after] |= kind[after] == LETTER
    new &= black
    start = np.flatnonzero(new)
    # it ends where the next one begins or its chunk ends
    end = np.minimum(np.append(start[1:], len(data)), stop[np.searchsorted(stop, start, side="right")] if len(start) else start)
    return lowered, start, end, kind[start] == WIDE


class UnitCache:
    """Encodes lists of texts; see the module's docstring."""

    def __init__(self, path: str, known: dict | None = None, most: int = MOST_UNITS):
        single_thread()
        from tokenizers import Tokenizer

        if known is None:
            with open(path, encoding="utf-8") as f:
                known = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.merges = Merges(known["model"])
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # in the order of their arrival
        self.table = Table((4 * self.most).bit_length())
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _fresh(self, raw: np.ndarray, lowered: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of units that aren't in the table."""
        plain = np.flatnonzero(~whole & (end - start <= 4 * LONGEST))
        flat, count = self.merges.apply(lowered, start[plain], end[plain])
        if len(plain) == len(start):
            return flat, count
        others = np.flatnonzero(whole | (end - start > 4 * LONGEST))
        some = [(raw if whole[i] else lowered)[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in others]
        got = [e.ids for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]
        counts = np.zeros(len(start), np.int64)
        counts[plain], counts[others] = count, [len(x) for x in got]
        first = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.uint32)
        out[spread(first[plain], count)] = flat
        out[spread(first[others], counts[others])] = [x for one in got for x in one]
        return out, counts

    def _piece(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte of each unit, numbers of ids up to each unit) of bytes that end with white space."""
        lowered, start, end, whole = units(raw)
        if not len(start):
            return np.zeros(0, np.uint32), start, np.zeros(1, np.int64)
        h = mix(span_hashes(lowered, start, end) + whole.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        long = end - start > LONGEST
        place = self.table.find(h)
        place[long] = -1
        missing = np.flatnonzero(place < 0)
        flat, first, length = self.flat, self.start, self.length
        if len(missing):
            key = np.where(long[missing], missing.astype(np.uint64) << np.uint64(1), h[missing])  # long ones each by itself
            _, at, back = np.unique(key, return_index=True, return_inverse=True)
            order = np.argsort(at, kind="stable")  # in the order of the text, so that frequent ones come early
            turn = np.empty(len(order), np.int64)
            turn[order] = np.arange(len(order))
            new = missing[at[order]]
            ids, counts = self._fresh(raw, lowered, start[new], end[new], whole[new])
            place[missing] = len(first) + turn[back]
            flat = np.concatenate([flat, ids])
            first = np.concatenate([first, len(self.flat) + np.cumsum(counts) - counts])
            length = np.concatenate([length, counts])
        own = length[place]
        out = flat[spread(first[place], own)]
        if len(missing):
            self._keep(flat, first, length, np.where(long[new], np.uint64(0), h[new]))
        return out, start, np.concatenate([[0], np.cumsum(own)])

    def _keep(self, flat: np.ndarray, first: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> None:
        old = len(self.hashes)
        kept = np.flatnonzero(hashes)
        if old + len(kept) > self.most:
            if old > self.most // 2:
                self._clear_to(self.most // 2)
            return
        self.table.add(hashes[kept], (old + np.arange(len(kept))).astype(np.int32))
        self.hashes = np.concatenate([self.hashes, hashes[kept]])
        if len(kept) == len(hashes):
            self.flat, self.start, self.length = flat, first, length
            return
        counts = length[old + kept]
        ids = flat[spread(first[old + kept], counts)]
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.flat, self.length = np.concatenate([self.flat, ids]), np.concatenate([self.length, counts])

    def _clear_to(self, n: int) -> None:
        hashes, start, length = self.hashes[:n].copy(), self.start[:n].copy(), self.length[:n].copy()
        flat = self.flat[: start[-1] + length[-1]].copy()
        self._clear()
        self.hashes, self.start, self.length, self.flat = hashes, start, length, flat
        self.table.add(hashes, np.arange(n, dtype=np.int32))

    def encode(self, texts: list[str | bytes]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        raw = [raw_bytes(t) for t in texts]
        out: list[list[np.ndarray]] = [[] for _ in raw]
        held: list[int] = []
        size = 0
        for i, t in enumerate(raw):
            if len(t) > PIECE:
                for a, z in cuts(t, PIECE):
                    out[i].append(self._piece(np.frombuffer(t[a:z] + b"\n", np.uint8))[0])
                continue
            if size + len(t) > PIECE:
                self._together(raw, held, out)
                held, size = [], 0
            held.append(i)
            size += len(t) + 1
        self._together(raw, held, out)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]

    def _together(self, raw: list[bytes], some: list[int], out: list) -> None:
        if not some:
            return
        ids, start, ends = self._piece(np.frombuffer(b"\n".join([*(raw[i] for i in some), b""]), np.uint8))
        stop = np.cumsum([len(raw[i]) + 1 for i in some])
        last = ends[np.searchsorted(start, stop)]
        for i, a, z in zip(some, np.concatenate([[0], last[:-1]]), last):
            out[i].append(ids[a:z])


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... up to count[i] of them, for all i."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
