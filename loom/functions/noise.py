"""Fractal gradient noise: coarse fields of products of neighbouring random directions, enlarged and averaged.

Enlarging is linear and separable, so it is a product with one matrix of weights for each axis."""

from __future__ import annotations

import numpy as np


def weights(n: int, m: int) -> np.ndarray:
    """(m, n): the shares of n samples in m that lie evenly over the same length; beyond the outer centres the edge holds."""
    place = np.clip((2 * np.arange(m) + 1) * n / (2 * m) - 0.5, 0, n - 1)
    return np.maximum(0, 1 - np.abs(place[:, None] - np.arange(n)))


def enlarged(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """The last two axes resampled."""
    return weights(x.shape[-2], height) @ x @ weights(x.shape[-1], width).T


def octaves(height: int, width: int, iterations: int = 0) -> list[int]:
    """Sizes of the coarse grids: the first powers of 2 below both sides of the image, as many as half the iterations,
    rounded up; no iterations make one and a single one makes two."""
    many = (iterations + 1) // 2 if iterations > 1 else 1 + iterations
    return [2**k for k in range(1, many + 1) if 2**k < min(height, width)]


def perlin(shape: tuple[int, ...], iterations: int = 0, seed: int = 0) -> np.ndarray:
    """(..., height, width) standardised noise. Directions are scaled along the height of their grid."""
    height, width = shape[-2:]
    seeds = np.random.default_rng(seed).standard_normal((int(np.prod(shape[:-2], dtype=int)), 2, height, width))
    sizes = octaves(height, width, iterations)
    fields = [enlarged(coarse(enlarged(seeds, n + 1, n + 1)), height, width) for n in sizes]
    mean = sum(fields, np.zeros((len(seeds), height, width))) / max(len(sizes), 1)
    centred = mean - mean.mean((-2, -1), keepdims=True)
    return (centred / (centred.std((-2, -1), keepdims=True, ddof=1) + 1e-8)).reshape(shape)


def coarse(grid: np.ndarray) -> np.ndarray:
    """(many, 2, n + 1, n + 1) directions -> (many, 2n, 2n): the inner products of the two directions on the right side
    of each cell with the two on its left."""
    unit = grid / (np.sqrt(np.square(grid).sum(-2, keepdims=True)) + 1e-8)
    corner = np.lib.stride_tricks.sliding_window_view(unit, (2, 2), (-2, -1))  # many, 2, n, n, row, column
    four = np.einsum("zdijr,zdijc->zirjc", corner[..., ::-1, 1], corner[..., 0])
    return four.reshape(len(four), 2 * four.shape[1], -1)
