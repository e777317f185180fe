"""Centre lines of a thresholded mask, one tile a group: a tile is one image, so it fits a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def blobs(mask: np.ndarray) -> np.ndarray:
    """The least pixel number of each pixel's blob (side by side, not across corners); -1 outside.

    Roots are hooked to the least root that they touch, and all paths shortened, until no two touch.
    """
    label = np.arange(mask.size)
    at = label.reshape(mask.shape)
    sides = [(at[:, :-1], at[:, 1:], mask[:, :-1] & mask[:, 1:]), (at[:-1], at[1:], mask[:-1] & mask[1:])]
    a, b = (np.concatenate([s[k][s[2]] for s in sides]) for k in (0, 1))
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return np.where(mask, label.reshape(mask.shape), -1)


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    """``mask`` without blobs of fewer than ``least`` pixels."""
    own = blobs(mask)
    size = np.bincount(own[mask], minlength=mask.size)
    return mask & (size[own] >= least)


def around(mask: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each pixel, clockwise from the one above."""
    p = np.pad(mask, 1)
    h, w = mask.shape
    return [p[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w] for dr, dc in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning: edge pixels go from two sides in turn, until none can."""
    mask, idle, side = mask.copy(), 0, 0
    while idle < 2:
        near = around(mask)
        n, e, s, w = near[0], near[2], near[4], near[6]
        count = np.sum(near, axis=0, dtype=np.int8)
        turns = np.sum([~p & q for p, q in zip(near, near[1:] + near[:1], strict=True)], axis=0, dtype=np.int8)
        held = (n & e & s) | (e & s & w) if side == 0 else (n & e & w) | (n & s & w)
        gone = mask & (count >= 2) & (count <= 6) & (turns == 1) & ~held
        mask &= ~gone
        idle, side = (0 if gone.any() else idle + 1), 1 - side
    return mask


def widen(line: np.ndarray, mask: np.ndarray, by: int) -> np.ndarray:
    """Pixels of ``mask`` within ``by`` of ``line``."""
    p, (h, w) = np.pad(line, by), line.shape
    out = np.zeros_like(line)
    for dr in range(-by, by + 1):
        for dc in range(-by, by + 1):
            if dr * dr + dc * dc <= by * by:
                out |= p[by + dr : by + dr + h, by + dc : by + dc + w]
    return out & mask


def centre_points(pixels: DataFrame, threshold: float, least: int = 0, by: int = 0) -> DataFrame:
    """(tile, x, y, score): centre line pixels of (tile, x, y, v) with v over the threshold.

    Blobs under ``least`` pixels are dropped, the line is widened ``by`` pixels in the mask.
    Of repeated pixels the greatest value counts; rows with nulls take no part.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
        left, top = x.min(), y.min()
        value = np.full((int(y.max() - top) + 1, int(x.max() - left) + 1), -np.inf)
        np.maximum.at(value, (y - top, x - left), pdf.v.to_numpy(np.float64))
        mask = np.isfinite(value)  # only what is over the threshold comes here
        if least > 0:
            mask = drop_small(mask, least)
        line = thin(mask)
        r, c = np.nonzero(widen(line, mask, by) if by > 0 else line)
        return pd.DataFrame({"tile": pdf.tile.iloc[0], "x": c + left, "y": r + top, "score": value[r, c]})

    over = pixels.select("tile", "x", "y", "v").dropna().where(f"v > {threshold}")
    return over.groupBy("tile").applyInPandas(run, "tile long, x long, y long, score double")
