"""Small rasters, one per group: components, holes, greedy groupings. A raster's size is its sensor's or room's, not the data's."""

from __future__ import annotations

import numpy as np


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Numbers 1, 2, ... of the connected true cells in row order of their first cell; 0 elsewhere."""
    out = np.zeros(mask.shape, np.int64)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    n = 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        out[start] = n
        todo = [start]
        while todo:
            i, j = todo.pop()
            for a, b in steps:
                k = (i + a, j + b)
                if 0 <= k[0] < mask.shape[0] and 0 <= k[1] < mask.shape[1] and mask[k] and not out[k]:
                    out[k] = n
                    todo.append(k)
    return out


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    """Cells of the 8-connected components that have at least `least` of them."""
    label = components(mask)
    return mask & (np.bincount(label.ravel())[label] >= least)


def voids(mask: np.ndarray) -> np.ndarray:
    """Components (4-connected) of the empty cells that do not touch the border."""
    label = components(~mask, diagonal=False)
    edge = np.unique(np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]]))
    label[np.isin(label, edge)] = 0
    return label


def greedy_groups(same: np.ndarray) -> np.ndarray:
    """Group of each item, in order: the first group whose first member it agrees with, or a new one."""
    heads: list[int] = []
    out = np.zeros(len(same), np.int64)
    for i in range(len(same)):
        g = next((k for k, h in enumerate(heads) if same[h, i]), len(heads))
        if g == len(heads):
            heads.append(i)
        out[i] = g
    return out


def first_without_clash(clash: np.ndarray) -> np.ndarray:
    """Mask of the items, in order, that clash with none kept before them."""
    kept = np.zeros(len(clash), bool)
    for i in range(len(clash)):
        kept[i] = not (clash[i, :i] & kept[:i]).any()
    return kept


def fused(boxes: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (u0, u1, z0, z1) and the group of each input, after pairs that are `near` became their bounding box until none is.

    `near` must hold for larger boxes if it holds for smaller ones; then the order of the pairs does not matter.
    """
    boxes, group = [tuple(b) for b in boxes], list(range(len(boxes)))
    live = list(range(len(boxes)))
    at = 0
    while at < len(live):
        a = live[at]
        b = next((k for k in live if k != a and near(boxes[a], boxes[k])), None)
        if b is None:
            at += 1
            continue
        boxes[a] = (min(boxes[a][0], boxes[b][0]), max(boxes[a][1], boxes[b][1]), min(boxes[a][2], boxes[b][2]), max(boxes[a][3], boxes[b][3]))
        group = [a if g == b else g for g in group]
        live.remove(b)
        at = 0  # the grown box may reach earlier ones
    return np.array(boxes), np.array(group)


def touching(gap: float):
    """Rectangles side by side within the gap that overlap in height, or stacked within it that overlap in width; never diagonal ones."""

    def near(a, b):
        u, z = min(a[1], b[1]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[2], b[2])
        return (-u <= gap and z > 0) or (-z <= gap and u > 0)

    return near


def shared_edge(a, b) -> int:
    """Cells along which two rectangles (row0, row1, col0, col1, inclusive) touch side by side."""
    rows, cols = min(a[1], b[1]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[2], b[2]) + 1
    if rows == 0 and cols > 0:
        return cols
    return rows if cols == 0 and rows > 0 else 0


def rooms(rects: list[tuple], heights: np.ndarray, seed: np.ndarray, tolerance: float) -> np.ndarray:
    """Room of each rectangle, numbered by first seed.

    Seeds that touch and agree in floor and ceiling are one room. The others join, in order and until
    nothing changes, the assigned one with the longest shared edge (the first of equals); islands are rooms of their own.
    """
    n = len(rects)
    edge = np.array([[shared_edge(a, b) if i != j else 0 for j, b in enumerate(rects)] for i, a in enumerate(rects)]).reshape(n, n)
    agree = (np.abs(heights[:, None] - heights[None]) <= tolerance).all(2)
    out = np.full(n, -1)
    number = 0
    for start in np.flatnonzero(seed):
        if out[start] >= 0:
            continue
        todo = [start]
        out[start] = number
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(seed & (out < 0) & (edge[i] > 0) & agree[i]):
                out[j] = number
                todo.append(j)
        number += 1
    changed = True
    while changed:
        changed = False
        for i in np.flatnonzero(out < 0):
            share = np.where(out >= 0, edge[i], 0)
            if share.max(initial=0) > 0:
                out[i] = out[int(share.argmax())]
                changed = True
    for i in np.flatnonzero(out < 0):
        out[i] = number
        number += 1
    return out


def lattice(values: np.ndarray, divisors=(1, 2, 3, 4)) -> tuple[float, float, float]:
    """(pitch, phase, rms) of the lattice that fits sorted positions best.

    Pitches are the median gap divided by small numbers, refined by least squares; of equally
    good ones (to nine digits) the larger pitch wins.
    """
    best = None
    gap = float(np.median(np.diff(values)))
    for d in divisors:
        pitch = gap / d
        k = np.rint((values - values[0]) / pitch)
        a = np.stack([k, np.ones(len(k))], 1)
        (p, c), *_ = np.linalg.lstsq(a, values, rcond=None)
        rms = float(np.sqrt(np.mean((values - a @ (p, c)) ** 2)))
        if best is None or (round(rms, 9), -p) < (round(best[2], 9), -best[0]):
            best = (float(p), float(c), rms)
    return best
