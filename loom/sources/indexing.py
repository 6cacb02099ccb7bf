"""Indexing of stored arrays: which positions of every axis an index needs, and the byte runs these are.

An index is anything NumPy takes on an array of that shape: integers, slices of any step, an ellipsis, new axes, integer arrays
and masks. It becomes, for every axis, the ascending positions it touches, and an index of the smaller array that these positions
make. Only the runs of the smaller array are read."""

from __future__ import annotations

import math

import numpy as np


def expanded(index, ndim: int) -> list:
    """The index as a list that spends every axis: masks as integer arrays, full slices after the ellipsis. That stays, as it keeps
    arrays before and after it apart."""
    items = [*index] if isinstance(index, tuple) else [] if index is Ellipsis else [index]
    out: list = []
    for item in items:
        if item is None or item is Ellipsis or isinstance(item, slice):
            out.append(item)
        elif isinstance(item, (bool, np.bool_)):
            raise TypeError("an index can't be a single truth value")
        elif isinstance(item, (int, np.integer)):
            out.append(int(item))
        else:
            array = np.asarray(item)
            if array.size == 0 and array.dtype.kind == "f":
                array = array.astype(np.int64)
            if array.dtype.kind not in "iub":
                raise TypeError("an index is made of integers, slices, ..., None, integer arrays and masks")
            out += [*array.nonzero()] if array.dtype.kind == "b" else [array.astype(np.int64)]
    spent = sum(x is not None and x is not Ellipsis for x in out)
    if spent > ndim:
        raise IndexError(f"{spent} indices for {ndim} dimensions")
    if sum(x is Ellipsis for x in out) > 1:
        raise IndexError("an index has one ellipsis at most")
    fill = [slice(None)] * (ndim - spent)
    at = next((i for i, x in enumerate(out) if x is Ellipsis), None)
    return out + fill if at is None else out[: at + 1] + fill + out[at + 1 :]


def compact(index, shape: tuple[int, ...]) -> tuple[list[np.ndarray], tuple]:
    """(ascending positions by axis, the index of the array that these make)."""
    positions: list[np.ndarray] = []
    inner: list = []
    for item in expanded(index, len(shape)):
        if item is None or item is Ellipsis:
            inner.append(item)
            continue
        axis = len(positions)
        size = shape[axis]
        if isinstance(item, slice):
            taken = range(size)[item]
            positions.append(np.arange(len(taken), dtype=np.int64) * abs(taken.step) + (min(taken[0], taken[-1]) if len(taken) else 0))
            inner.append(slice(None, None, -1 if taken.step < 0 else 1))
            continue
        array = np.asarray(item, np.int64)
        if array.size and not (-size <= array.min() and array.max() < size):
            raise IndexError(f"an index is out of range for axis {axis} of {size}")
        unique, back = np.unique(array % size if size else array, return_inverse=True)
        positions.append(unique.astype(np.int64))
        inner.append(int(back.reshape(-1)[0]) if isinstance(item, int) else back.reshape(array.shape))
    return positions, tuple(inner)


def stretches(positions: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the stretches of ascending positions; stretches with at most `gap` missing between them are one."""
    if not len(positions):
        return positions, positions
    cut = np.flatnonzero(np.diff(positions) > 1 + gap) + 1
    first, last = positions[np.append(0, cut)], positions[np.append(cut - 1, len(positions) - 1)]
    return first, last - first + 1


def byte_runs(positions: list[np.ndarray], shape: tuple[int, ...], item: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, sizes) of the runs of a row-major array of `item` bytes an element that these positions are, in order. Trailing
    axes taken whole, and neighbouring positions of the axis before them, lie together."""
    if any(len(p) == 0 for p in positions):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = len(shape)
    while cut and len(positions[cut - 1]) == shape[cut - 1]:
        cut -= 1
    inner = math.prod(shape[cut:]) * item
    if not cut:
        return np.zeros(1, np.int64), np.array([inner], np.int64)
    first, length = stretches(positions[cut - 1])
    starts = np.zeros(1, np.int64)
    for d in range(cut - 1):
        starts = (starts[:, None] + positions[d] * (math.prod(shape[d + 1 :]) * item)).ravel()
    return (starts[:, None] + first * inner).ravel(), np.tile(length * inner, len(starts))


def merged_runs(offsets: np.ndarray, sizes: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """(offset, size) of the reads to do where runs with at most `gap` bytes between them are read as one."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(offsets[1:] - offsets[:-1] - sizes[:-1] > gap) + 1
    first, last = np.append(0, cut), np.append(cut - 1, len(offsets) - 1)
    return list(zip(offsets[first].tolist(), (offsets[last] + sizes[last] - offsets[first]).tolist()))


def read_runs(read_at, offsets: np.ndarray, sizes: np.ndarray, gap: int = 0) -> bytearray:
    """The bytes of the runs, one after the other; read_at(offset, size) gives those of one read."""
    out, at, i = bytearray(int(sizes.sum())), 0, 0
    for offset, size in merged_runs(offsets, sizes, gap):
        piece = memoryview(read_at(offset, size))
        if len(piece) < size:
            raise ValueError("the array is cut off")
        while i < len(offsets) and offsets[i] + sizes[i] <= offset + size:
            n = int(sizes[i])
            out[at : at + n] = piece[int(offsets[i]) - offset :][:n]
            at, i = at + n, i + 1
    return out


def parsed(text: str):
    """An index written as in NumPy, without new axes and arrays of arrays: "1:10:2, ..., -1, [0, 3]"."""
    items, depth, word = [], 0, ""
    for c in [*text, ","]:
        depth += (c == "[") - (c == "]")
        if c != "," or depth:
            word += c
            continue
        word = word.strip()
        if word == "...":
            items.append(Ellipsis)
        elif word.startswith("["):
            items.append([int(x) for x in word[1:-1].split(",") if x.strip()])
        elif ":" in word:
            items.append(slice(*[int(x) if x.strip() else None for x in word.split(":")]))
        elif word:
            items.append(int(word))
        word = ""
    return tuple(items)
