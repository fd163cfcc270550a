"""Shortest ways on grids of floor cells: a bucket queue over 8 neighbours, for many sources of a scene at once.

Distances are whole numbers (STRAIGHT and DIAGONAL a step), so they do not depend on the order of sums or on how a grid
is cut. A bucket holds the cells whose distance lies in one straight step's width: no step is shorter, so a bucket is final
when it comes up and all its cells, of all sources, go on together.

A scene's floor travels packed, 64 cells in a number. Sources are dealt to blocks; a task holds the floor of one scene and
the distances of as many sources as HELD_DISTANCES allows. Scenes of more cells than that are searched by tiles (tiles.py)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps in units of 10^-12 cells: sums are whole numbers, so equal lengths are equal however they are summed.
STRAIGHT, DIAGONAL = 10**12, 1_414_213_562_373
NEAR = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1) if di or dj]
#: Distances that a task holds at once (sources times cells of the scene, 8 bytes each).
HELD_DISTANCES = 4_000_000
#: No way yet; walls hold -1, which no way is shorter than.
FAR, WALL = np.int64(1) << 62, np.int64(-1)


def padded(floor: np.ndarray, sources: int = 1) -> np.ndarray:
    """Distances of no way, for each source, with a border of walls."""
    out = np.full((sources, floor.shape[0] + 2, floor.shape[1] + 2), WALL)
    out[:, 1:-1, 1:-1] = np.where(floor, FAR, WALL)
    return out


def settle(held: np.ndarray, seeds: np.ndarray, most: int | None = None) -> np.ndarray:
    """Lowers held (of padded()) to the shortest distances that follow from its seeds, flat places whose distances are set; returns the places lowered.

    Ways longer than most are not followed."""
    flat, width = held.reshape(-1), held.shape[2]
    steps = [(di * width + dj, DIAGONAL if di and dj else STRAIGHT) for di, dj in NEAR]
    buckets: dict[int, list[np.ndarray]] = {}

    def put(places: np.ndarray) -> None:
        number = flat[places] // STRAIGHT
        for k in np.unique(number).tolist():
            buckets.setdefault(k, []).append(places[number == k])

    put(np.unique(seeds))
    lowered = []
    while buckets:
        k = min(buckets)
        places = np.unique(np.concatenate(buckets.pop(k)))
        places = places[flat[places] // STRAIGHT == k]  # others have been lowered into an earlier bucket
        new = []
        for offset, step in steps:
            there, length = places + offset, flat[places] + step
            better = length < flat[there]
            if most is not None:
                better &= length <= most
            there = there[better]
            flat[there] = length[better]
            new.append(there)
        found = np.concatenate(new)
        if len(found):
            lowered.append(found)
            put(found)
    return np.unique(np.concatenate(lowered)) if lowered else np.empty(0, np.int64)


def distances(floor: np.ndarray, sources: np.ndarray, most: int | None = None) -> np.ndarray:
    """Units from each source cell to every cell, -1 where there is no way (or none within most)."""
    held = padded(floor, len(sources))
    held[np.arange(len(sources)), sources[:, 0] + 1, sources[:, 1] + 1] = 0
    size = held.shape[1] * held.shape[2]
    settle(held, np.arange(len(sources)) * size + (sources[:, 0] + 1) * held.shape[2] + sources[:, 1] + 1, most)
    inner = held[:, 1:-1, 1:-1]
    return np.where(inner >= FAR, WALL, inner)


def step_back(held: np.ndarray, i: int, j: int) -> tuple[int, int] | None:
    """The least neighbour from which a shortest way comes to a cell; held has a border, and -1 or FAR where no way goes."""
    here = held[i, j]
    for di, dj in NEAR:  # in order of the cell
        before = held[i + di, j + dj]
        if 0 <= before < here and before + (DIAGONAL if di and dj else STRAIGHT) == here:
            return i + di, j + dj
    return None


def walked(distance: np.ndarray, goal: tuple[int, int]) -> list[tuple[int, int]]:
    """The cells of a shortest path to goal, by the distances of one source; of equal ways back the least cell is taken."""
    held = np.pad(distance, 1, constant_values=WALL)
    at, path = (int(goal[0]) + 1, int(goal[1]) + 1), []
    while at is not None:
        path.append((at[0] - 1, at[1] - 1))
        at = step_back(held, *at)
    return path[::-1]


def all_walked(distance: np.ndarray, number: np.ndarray, goals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The paths of walked() to goals (rows of i, j), all at once: number names the source of each goal in distance (source, i, j).

    Where each path begins and the last one ends, and i and j of the cells of all paths."""
    held = np.pad(distance, ((0, 0), (1, 1), (1, 1)), constant_values=WALL)
    flat, (_, height, width) = held.reshape(-1), held.shape
    open_, at, rounds = np.arange(len(goals)), (number * height + goals[:, 0] + 1) * width + goals[:, 1] + 1, []
    while len(open_):
        rounds.append((open_, at))
        here, back = flat[at], np.full(len(at), -1)
        for di, dj in reversed(NEAR):  # the first of NEAR is put last, so it stays
            there = at + di * width + dj
            fits = (flat[there] >= 0) & (flat[there] + (DIAGONAL if di and dj else STRAIGHT) == here)
            back[fits] = there[fits]
        open_, at = open_[back >= 0], back[back >= 0]
    count = np.zeros(len(goals), np.int64)
    for own, _ in rounds:
        count[own] += 1
    ends = np.r_[0, np.cumsum(count)]
    cells = np.empty(ends[-1], np.int64)
    for k, (own, places) in enumerate(rounds):
        cells[ends[own + 1] - 1 - k] = places
    return ends, cells // width % height - 1, cells % width - 1


def packed(floor: DataFrame) -> DataFrame:
    """scene_id, i, block_j and bits of floor cells (scene_id, i, j): bit k of bits is the cell 64 * block_j + k."""
    bit = F.expr("shiftleft(1L, cast(pmod(j, 64) AS int))")
    return floor.groupBy("scene_id", "i", F.floor(F.col("j") / 64).cast("int").alias("block_j")).agg(F.bit_or(bit).alias("bits"))


def unpacked(i: np.ndarray, block_j: np.ndarray, bits: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A floor of (at least) the given shape from packed rows."""
    shape = max(shape[0], int(i.max(initial=-1)) + 1), max(-(-shape[1] // 64), int(block_j.max(initial=-1)) + 1) * 64
    floor = np.zeros(shape, bool)
    spread = np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    floor.reshape(shape[0], -1, 64)[i, block_j] = spread
    return floor


def sizes(floor: DataFrame) -> DataFrame:
    """scene_id and cells: those of the box from (0, 0) that holds a scene's floor."""
    box = ((F.max("i") + 1).cast("long") * (F.max("j") + 1)).alias("cells")
    return floor.groupBy("scene_id").agg(box)


def blocks(cells, sources):
    """Blocks that the sources of a scene are dealt to."""
    return F.least(sources, F.ceil(sources * cells / HELD_DISTANCES))
