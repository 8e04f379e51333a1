"""A seeded test graph: Gaussian cliques with outliers."""

from __future__ import annotations

import dataclasses
import math

import numpy as np

SPACING = 20.0
# Fixed values of the third and fourth dimension: cliques to a step, steps to a turn, share of the spacing.
PATTERN = ((1, 3, 0.8), (3, 3, 0.6))
OUTLIER_SHARE = 0.05


@dataclasses.dataclass(frozen=True)
class CliqueGraph:
    rows: np.ndarray
    clique: np.ndarray  # -1: outlier
    norms: np.ndarray
    adjacency: np.ndarray


def sizes(n: int, k: int) -> tuple[list[int], int]:
    """Members of each clique, the first ones taking the remainder, and outliers."""
    outliers = math.floor(n * OUTLIER_SHARE + 0.5)
    each, rest = divmod(n - outliers, k)
    return [each + (c < rest) for c in range(k)], outliers


def centres(k: int, dims: int, rng: np.random.Generator) -> np.ndarray:
    """On a square grid in the first two dimensions, apart in the others too."""
    side = math.ceil(math.sqrt(k))
    out = np.zeros((k, dims))
    patterned = max(1, 2 * k // 3)
    for c in range(k):
        out[c, : min(2, dims)] = np.array([c % side, c // side])[:dims] * SPACING
        if c < patterned:
            for d, (every, turns, share) in zip(range(2, min(dims, 4)), PATTERN):
                out[c, d] = c // every % turns * share * SPACING
            out[c, 4:] = rng.uniform(-0.2, 0.2, max(0, dims - 4)) * SPACING
        else:
            out[c, 2:] = rng.uniform(-0.3, 0.3, max(0, dims - 2)) * SPACING
    return out


def gaussian_cliques(n: int = 150, noise: float = 0.3, k: int = 5, dims: int = 300, seed: int = 42) -> CliqueGraph:
    """``n`` shuffled points: k cliques around their centres and 5 % outliers without neighbours."""
    rng = np.random.default_rng(seed)
    members, outliers = sizes(n, k)
    clique = np.concatenate([np.repeat(np.arange(k), members), np.full(outliers, -1)])
    grid = math.ceil(math.sqrt(k)) * SPACING
    middle = centres(k, dims, rng)
    rows = np.where(clique[:, None] >= 0, middle[clique] + rng.normal(0, noise, (n, dims)), rng.uniform(-10, grid + 10, (n, dims)))
    order = rng.permutation(n)
    rows, clique = rows[order], clique[order]
    adjacency = ((clique[:, None] == clique[None, :]) & (clique[:, None] >= 0)).astype(float)
    np.fill_diagonal(adjacency, 0)
    return CliqueGraph(rows, clique, np.linalg.norm(rows, axis=1), adjacency)
