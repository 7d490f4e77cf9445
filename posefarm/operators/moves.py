"""Pattern search of one block of poses inside a task.

Spark builds the receptor's cells, deals complexes and blocks of poses out and brings them
together; what is here scores the moves of such a block with numpy, against the same cells and by
the same rules as ``cells.met_scores``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from posefarm.functions.columns import apply_matrix, quat_mul, rotation_matrix
from posefarm.operators.cells import CELL, TYPES
from posefarm.operators.scoring import Weights

XYZ = "xyz"
#: (placement, atom, cell) triples looked at together.
TOGETHER = 1 << 20


class Scorer:
    """Scores of rigid placements of one ligand on the cells of one receptor.

    ``cells``: ix, iy, iz and the channels of ``cells.receptor_channels``; ``ligand``: x, y, z,
    radius, sasa, charge and type_id by atom; ``grid``: x0, y0, z0 and h.  Cells are found by
    their place in the box that holds them, so the box has to be of bounded size.
    """

    def __init__(self, cells: dict[str, np.ndarray], ligand: dict[str, np.ndarray], grid: dict[str, float], weights: Weights, threshold: float):
        self.h, self.origin, self.weights = grid["h"], [grid[f"{a}0"] for a in XYZ], weights
        here = ~np.isnan(sum(ligand[c] for c in (*XYZ, "radius")))
        self.atoms = {k: v[here] for k, v in ligand.items()}
        self.shown = self.atoms["sasa"] > threshold
        self.charge = np.nan_to_num(self.atoms["charge"])
        kind = np.nan_to_num(self.atoms["type_id"]).astype(np.int64)
        self.kind = np.where((kind >= 1) & (kind <= TYPES), kind, 0)
        # Cells whose centre lies within a radius are at most this many away from the nearest one.
        self.wide = int(np.floor(self.atoms["radius"].max(initial=0.0) / self.h + 0.5))
        ijk = [cells[c] for c in CELL]
        self.empty = not len(ijk[0]) or not here.any()
        if self.empty:
            return
        pad = 2 * self.wide + 1
        self.low = [int(c.min()) - pad for c in ijk]
        self.size = [int(c.max()) + pad + 1 - lo for c, lo in zip(ijk, self.low)]
        self.at = np.zeros(self.size, np.int32).ravel()
        self.at[self._flat([c - lo for c, lo in zip(ijk, self.low)])] = np.arange(1, len(ijk[0]) + 1)
        # Row 0 stands for cells that the receptor does not reach.
        row = lambda name: np.concatenate([[0.0], cells[name]])
        self.open = row("open")
        self.felt = row("charge") if weights.beta else None
        self.pair = np.stack([np.zeros(len(ijk[0]) + 1), *[row(f"pair{i}") for i in range(1, TYPES + 1)]], 1).ravel() if weights.table else None
        self.cover = (row("outer") + 2 * row("inner")).astype(np.int8)[self.at]
        steps = np.arange(-self.wide, self.wide + 1)
        self.steps = [s.ravel() for s in np.meshgrid(steps, steps, steps, indexing="ij")]

    def _flat(self, ijk: Sequence[np.ndarray]) -> np.ndarray:
        return (ijk[0] * self.size[1] + ijk[1]) * self.size[2] + ijk[2]

    def __call__(self, q: Sequence[np.ndarray], t: Sequence[np.ndarray]) -> np.ndarray:
        """Score of every placement; one that leaves the receptor's cells altogether scores nothing."""
        if self.empty:
            return np.zeros(len(t[0]))
        width = max(1, TOGETHER // (len(self.kind) * len(self.steps[0])))
        parts = [slice(i, i + width) for i in range(0, len(t[0]), width)]
        return np.concatenate([np.zeros(0), *[self._some([v[s] for v in q], [v[s] for v in t]) for s in parts]])

    def _some(self, q: Sequence[np.ndarray], t: Sequence[np.ndarray]) -> np.ndarray:
        n = len(t[0])
        m = [e[:, None] for e in rotation_matrix(q)]
        place = [v + s[:, None] for v, s in zip(apply_matrix(m, [self.atoms[a] for a in XYZ]), t)]
        near = [np.rint((p - o) / self.h) for p, o in zip(place, self.origin)]
        inside = np.ones(place[0].shape, bool)
        for c, lo, size in zip(near, self.low, self.size):
            inside &= (c >= lo + self.wide) & (c < lo + size - self.wide)
        flat = np.where(inside, self._flat([np.where(inside, c, 0.0).astype(np.int64) - lo for c, lo in zip(near, self.low)]), 0)
        cell = self.at[flat]
        gain = self.weights.alpha * self.open[cell]
        if self.felt is not None:
            gain = gain + self.weights.beta * self.charge * self.felt[cell]
        score = gain.sum(1)
        if self.pair is not None:
            # Atoms of one type at one cell count once.
            key = np.sort(cell.astype(np.int64) * (TYPES + 1) + self.kind, axis=1)
            energy = self.pair[key]
            energy[:, 1:][key[:, 1:] == key[:, :-1]] = 0.0
            score = score + energy.sum(1)
        return score + self._clashes(place, near, inside, flat, n)

    def _clashes(self, place: Sequence[np.ndarray], near: Sequence[np.ndarray], inside: np.ndarray, flat: np.ndarray, n: int) -> np.ndarray:
        """What overlaps cost: every cell that both sides cover counts once a placement."""
        both, one_inside, core = (-float(w) for w in self.weights.clash)
        probe, atom = np.nonzero(inside)
        base = flat[probe, atom]
        hit, step = np.nonzero(self.cover[base[:, None] + ((self.steps[0] * self.size[1] + self.steps[1]) * self.size[2] + self.steps[2])])
        probe, atom, base = probe[hit], atom[hit], base[hit]
        d2 = 0.0
        for a, p, c, s, o in zip(XYZ, place, near, self.steps, self.origin):
            gap = p[probe, atom] - (o + (c[probe, atom] + s[step]) * self.h)
            d2 = d2 + gap * gap
        r = self.atoms["radius"][atom]
        covers = (np.sqrt(d2) < r) & (d2 < r * r) & ~np.isnan(self.atoms["sasa"][atom])
        probe, shown = probe[covers], self.shown[atom[covers]]
        met = base[covers] + ((self.steps[0] * self.size[1] + self.steps[1]) * self.size[2] + self.steps[2])[step[covers]]
        # The last of equal cells is an exposed one, if any is.
        key = np.sort((probe * len(self.cover) + met) * 2 + shown)
        last = np.ones(len(key), bool)
        last[:-1] = key[1:] >> 1 != key[:-1] >> 1
        key = key[last]
        outer, shown = self.cover[(key >> 1) % len(self.cover)] == 1, key & 1 == 1
        cost = np.where(outer, np.where(shown, both, one_inside), np.where(shown, one_inside, core))
        return np.bincount((key >> 1) // len(self.cover), cost, minlength=n)


def moved(q: Sequence[np.ndarray], t: Sequence[np.ndarray], g: Sequence[np.ndarray], x: Sequence[np.ndarray]) -> tuple[list, list]:
    """Placements at x0 .. x5 from their starts: one turn about the starting centroid and one shift."""
    turn = np.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    half = np.radians(turn) / 2
    axis = [np.divide(c, turn, out=np.zeros_like(turn), where=turn > 0) for c in x[:3]]
    e = [-a * np.sin(half) for a in axis] + [np.cos(half)]
    arm = apply_matrix(rotation_matrix(e), [a - b for a, b in zip(t, g)])
    return quat_mul(q, e), [a + b + c for a, b, c in zip(arm, g, x[3:])]


def search(score: Scorer, q: Sequence[np.ndarray], t: Sequence[np.ndarray], g: Sequence[np.ndarray], deg: float, shift: float,
           stop_deg: float, rounds: int | None, levels: int) -> dict[str, np.ndarray]:
    """The pattern search of ``search.pattern_refine`` for the poses (q, t) of one complex."""
    n = len(t[0])
    x, deg, shift = np.zeros((6, n)), np.full(n, float(deg)), np.full(n, float(shift))
    value = start = score(q, t)
    value = value.copy()
    done = 0
    while (rounds is None or done < rounds) and (deg > stop_deg).any():
        done += 1
        active = np.flatnonzero(deg > stop_deg)
        for _ in range(levels):
            if not len(active):
                break
            size = np.stack([deg[active]] * 3 + [shift[active]] * 3)
            tried = np.repeat(x[:, active][:, :, None], 12, axis=2)
            for i in range(6):
                tried[i, :, 2 * i] += size[i]
                tried[i, :, 2 * i + 1] -= size[i]
            wide = lambda v: np.repeat(v[active], 12)
            got = score(*moved([wide(v) for v in q], [wide(v) for v in t], [wide(v) for v in g], tried.reshape(6, -1))).reshape(-1, 12)
            # The last bits of a sum do not tell moves of equal score apart: the first counts.
            best = np.round(got, 9).argmax(1)
            top = got[np.arange(len(active)), best]
            better = top > value[active] + 1e-9
            won, lost = active[better], active[~better]
            x[:, won] = tried[:, better, best[better]]
            value[won] = top[better]
            deg[lost] *= 0.5
            shift[lost] *= 0.5
            active = lost[deg[lost] > stop_deg]
    q, t = moved(q, t, g, x)
    return {"score": value, "start_score": start, "deg": deg, "shift": shift} | {f"q{i + 1}": v for i, v in enumerate(q)} | {f"t{a}": v for a, v in zip(XYZ, t)}


def _numbers(column: pa.Array | pa.ChunkedArray, nothing: float = np.nan) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.cast(pa.float64()).fill_null(nothing), float)


def refine_block(block: pa.Table, cells: pa.Table, weights: Weights, names: Sequence[str], threshold: float, how: dict) -> pa.Table:
    """Refined poses of one block: ``block`` is one row with the grid, the ligand's atoms and the
    poses, ``cells`` the receptor's channels."""
    ligand = block["lig"].combine_chunks().flatten().flatten()
    ligand = {f.name: _numbers(c) for f, c in zip(block.schema.field("lig").type.value_type, ligand)}
    poses = block["poses"].combine_chunks().flatten()
    part = {f.name: c for f, c in zip(poses.type, poses.flatten())}
    grid = {c: block[c][0].as_py() for c in ("x0", "y0", "z0", "h")}
    found = {c: _numbers(cells[c], 0.0) for c in names} | {c: np.asarray(cells[c].combine_chunks(), np.int64) for c in CELL}
    value = {c: _numbers(v) for c, v in part.items() if c != "pose_id"}
    out = search(Scorer(found, ligand, grid, weights, threshold), [value[f"q{i}"] for i in range(1, 5)], [value[f"t{a}"] for a in XYZ],
                 [value[f"g{a}"] for a in XYZ], **how)
    n = len(poses)
    key = pa.chunked_array([block["complex_id"].combine_chunks().take(pa.array(np.zeros(n, np.int64)))])
    return pa.table({"complex_id": key, "pose_id": part["pose_id"]} | {k: pa.array(np.asarray(v, float)) for k, v in out.items()})
