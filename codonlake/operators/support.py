"""Epsilon support vector regression over rows that stay distributed: linear, or with a radial kernel.

The linear one is solved in the primal by Newton's method along the central path: each row's slack under a logarithmic
barrier has a closed form, so rows bear no state. A step is one pass over the rows, for the models of all folds together:
each task sums losses, gradients and curvatures, and the driver gets sums whose size depends on the features alone. A model
is done when the duality gap of the path, 4 C times the barrier a row, is below GAP of the primal value.

A radial kernel of few features has few directions that matter. Landmarks are taken from the rows until no row keeps more
than RESIDUAL of its unit norm outside their span (each row is tested, in every round); the model lives in that span, and
few rows decide it: kernel_solved gathers those near the tube's edge, and tests the others in one pass over all rows.
The loss of this is at most rows * RESIDUAL / 2 in an objective of about a tenth of the rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.operators import linear

C, EPSILON = 1.0, 0.1
GAP = 1e-4
SHRINK = 0.3
RESIDUAL = 1e-6
MOST_PASSES = 400
#: Landmarks that the driver solves for; data that ask for more have no low rank.
MOST_LANDMARKS = 4000
#: Rows that propose landmarks in a round, over all batches; and numbers of a slice that a task works on.
PROPOSED, SLICE = 8000, 1 << 21
#: Rows by feature that make up a curvature of more than EXACT_WIDTH features; of more rows, some stand for all, picked in
#: proportion to their weight. Only the steps depend on it: loss, gradient and gap are sums of all rows.
CURVATURE_ROWS, EXACT_WIDTH = 40, 64
#: Of a kernel's model: rows that the first one is made of, how many times more the next has, and how near to the tube's edge
#: a row is free after the first (less after more rows, and in the second round); bytes of the basis that a task keeps; steps at most, in all and
#: without a smaller gap, rounds, and other rows that bound a model.
FIRST_ROWS, GROWTH, BAND, NARROWER = 6000, 3, 0.08, 0.4
KEPT_BYTES = 256 << 20
MOST_STEPS, STUCK, MOST_ROUNDS, GUARDS = 100, 20, 20, 4000


def radial(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | slice]:
    """(different rows, place of each row's among them); x itself and all of it if most rows differ."""
    if len(x) < 64:
        return x, slice(None)
    mixed = np.zeros(len(x), np.uint64)
    for column in x.T:
        mixed = (mixed ^ np.ascontiguousarray(column).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, first, place = np.unique(mixed, return_index=True, return_inverse=True)
    if 2 * len(first) > len(x) or not np.array_equal(x[first][place], x):
        return x, slice(None)
    return x[first], place


@dataclass
class Space:
    """Features of the model that leaves `fold` out: rows in standard units, or their kernel with the landmarks."""

    fold: int | None
    means: np.ndarray
    deviations: np.ndarray
    gamma: float = 0.0
    marks: np.ndarray | None = None  # standardised landmarks
    root: np.ndarray | None = None  # makes kernel values orthonormal coordinates

    @property
    def width(self) -> int:
        return len(self.means) if self.marks is None else len(self.marks)

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.means) / self.deviations
        return z if self.marks is None else radial(z, self.marks, self.gamma)

    def whitened(self, basis: np.ndarray) -> np.ndarray:
        return basis if self.root is None else basis @ self.root

    def weights(self, w: np.ndarray) -> np.ndarray:
        """What the basis is multiplied with, of coordinates."""
        return w if self.root is None else self.root @ w

    def predict(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        step, own = max(256, SLICE // max(1, self.width)), self.weights(w[:-1])
        few, place = distinct(x) if self.marks is not None else (x, slice(None))
        if len(few) < len(x):
            return self.predict(few, w)[place]
        return np.concatenate([self.basis(x[at : at + step]) @ own for at in range(0, len(x), step)] or [np.zeros(0)]) + w[-1]


def _inverse_root(kernel: np.ndarray) -> np.ndarray:
    return np.linalg.inv(np.linalg.cholesky(kernel + 1e-12 * np.eye(len(kernel)))).T


def _kind(width: int):
    """Large curvatures travel in single precision: only the length of the steps depends on them."""
    return np.float32 if width > 512 else np.float64


@dataclass
class Model:
    """A model while it is fitted, and when it is done."""

    at: int
    w: np.ndarray
    barrier: float = EPSILON
    share: float = 1.0  # of the rows in the curvature
    origin: np.ndarray | None = None
    turn: np.ndarray | None = None
    step: float = 1.0
    slope: float = 0.0
    base: float | None = None
    done: bool = False


def _hinge(t: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(t, 0) under a barrier: the least s - mu log(s) - mu log(s - t), its slope (between 0 and 1) and its curvature."""
    root = np.sqrt(t * t + 4 * mu * mu)
    far = np.abs(t) + root  # no cancellation: the smaller of both distances from the larger
    room, slack = mu + np.where(t > 0, 2 * mu * mu / far, far / 2), mu + np.where(t > 0, far / 2, 2 * mu * mu / far)  # s - t, s
    lag = np.where(t > 0, 2 * mu * mu / far, far / 2) / root  # (1 - t / root) / 2
    return slack - mu * np.log(slack) - mu * np.log(room), mu / room, mu * lag / room**2


def _partial(spaces, models: list[tuple[int, np.ndarray, float, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, curves = {}, {}
        for at, w, _, _ in models:
            heads[at] = np.zeros(len(w) + 4)
            curves[at] = np.zeros((len(w), len(w)))
        own = {at: spaces.value[at].weights(w[:-1]) for at, w, _, _ in models}
        for b in batches:
            fold = b.column(0).to_numpy(zero_copy_only=False)
            columns = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)])
            for at, w, mu, share in models:
                space = spaces.value[at]
                part = columns if space.fold is None else columns[fold != space.fold]
                length = max(256, SLICE // max(1, space.width))
                for i in range(0, len(part), length):
                    y, x = part[i : i + length, 0], part[i : i + length, 1:]
                    basis = space.basis(x)
                    left = y - basis @ own[at] - w[-1]
                    (above, p, bent), (below, q, bent_too) = _hinge(left - EPSILON, mu), _hinge(-left - EPSILON, mu)
                    beta, weight = C * (p - q), C * (bent + bent_too)
                    head = heads[at]
                    head[:4] += C * (above + below).sum(), C * np.maximum(np.abs(left) - EPSILON, 0).sum(), beta.sum(), len(y)
                    head[4:-1] += beta @ basis
                    some = int(np.ceil(share * len(y)))
                    if some < len(y):
                        ahead = np.cumsum(weight)
                        basis = basis[np.searchsorted(ahead, (np.arange(some) + 0.5) * (ahead[-1] / some))]
                        weight = np.full(some, ahead[-1] / some)
                    z = np.column_stack([space.whitened(basis), np.ones(len(basis))]) * np.sqrt(weight)[:, None]
                    curves[at] += z.T @ z
        for at, w, _, _ in models:
            curve = curves[at][np.triu_indices(len(w))].astype(_kind(len(w)))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([heads[at].tobytes()], pa.binary()), pa.array([curve.tobytes()], pa.binary())], names=["at", "head", "curve"])

    return run


def _added(table: pa.Table) -> pa.Table:
    order = sorted(range(table.num_rows), key=lambda i: table.column("head")[i].as_py())  # the same sum whatever comes first
    heads, curves = ([table.column(c)[i].as_py() for i in order] for c in ("head", "curve"))
    width = len(heads[0]) // 8 - 4
    add = lambda parts, kind: sum(np.frombuffer(p, kind).astype(np.float64) for p in parts)
    return pa.table({"at": table.column("at")[:1], "head": pa.array([add(heads, np.float64).tobytes()], pa.binary()), "curve": pa.array([add(curves, _kind(width)).astype(_kind(width)).tobytes()], pa.binary())})


def _moved(m: Model, space: Space, head: np.ndarray, curve: np.ndarray) -> None:
    """One Newton step of a model from the sums of a pass, or its end."""
    free = space.marks is not None  # the kernel's bias bears no penalty
    held = m.w.copy()
    if free:
        held[-1] = 0.0
    smooth, loss, total, n = head[:4]
    value = held @ held / 2 + smooth
    if m.base is not None and value > m.base + 1e-4 * m.step * m.slope + 1e-13 * abs(m.base) and m.step > 1e-6:
        curved = value - m.base - m.step * m.slope
        m.step *= min(0.5, max(0.1, -m.slope * m.step / (2 * curved))) if curved > 0 else 0.5
        m.w = m.origin + m.step * m.turn
        return
    pull = head[4:-1] if space.root is None else space.root.T @ head[4:-1]
    pull = np.append(pull, total)
    primal = held @ held / 2 + loss
    slope = held - pull
    matrix = np.zeros((len(m.w),) * 2)
    matrix[np.triu_indices(len(m.w))] = curve
    matrix = matrix + np.triu(matrix, 1).T
    ridge = np.ones(len(m.w))
    if free:
        ridge[-1] = 1e-12 * max(1.0, matrix[-1, -1])
    turn = -np.linalg.solve(matrix + np.diag(ridge), slope)
    fall = -slope @ turn
    m.origin, m.turn, m.step, m.slope, m.base = m.w, turn, 1.0, -fall, value
    if fall <= m.barrier * max(1.0, 0.02 * C * n):  # near the path, where the gap is that of the barrier
        if 4 * C * m.barrier * n <= GAP * max(primal, 1e-12):
            m.done = True
        m.barrier, m.base = m.barrier * SHRINK, None
    m.w = m.w + turn


def _split(columns: np.ndarray, space: Space, past: list[np.ndarray], band: float, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | slice]:
    """(free rows, class, residuals, residuals of `also`, basis of the different rows, their places) of rows given as
    (te, features), under the models `past`.

    Class: the side of the tube that a row is on, 0 within. Free: closer than `band` to the tube's edge under the last
    model, or of another class under one before.
    """
    few, place = distinct(columns[:, 1:])
    basis = space.basis(few)
    models = past if also is None else [*past, also]
    left = columns[:, :1] - (basis @ np.column_stack([m[:-1] for m in models]))[place] - np.array([m[-1] for m in models])
    side = np.sign(left) * (np.abs(left) > EPSILON)
    last = len(past) - 1
    free = np.abs(np.abs(left[:, last]) - EPSILON) <= band
    for k in range(last):
        free |= side[:, k] != side[:, last]
    return free, side[:, last], left[:, last], left[:, -1], basis, place


def _own(columns: np.ndarray, fold: np.ndarray, space: Space) -> Iterator[np.ndarray]:
    """The rows that a space's model is trained on, in slices."""
    part = columns if space.fold is None else columns[fold != space.fold]
    length = max(256, SLICE // max(1, space.width))
    for i in range(0, len(part), length):
        yield part[i : i + length]


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(zero_copy_only=False), np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)])


def _drawn(columns: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each row, by its bits."""
    mixed = np.zeros(len(columns), np.uint64)
    for column in columns.T:
        mixed = (mixed ^ np.ascontiguousarray(column).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(11)) / float(1 << 53)


def _freed(spaces, asked: list[tuple]):
    """Of each model asked for: its free rows, and the sums of the others, whose multipliers are known. A share of the
    others is sent too, with what each stands for and its class: they keep the rest from changing sides unseen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, columns = _arrays(b)
            for key, (at, past, band, share, _, _) in enumerate(asked):
                space, sums, rows = spaces.value[at], np.zeros(spaces.value[at].width + 2), []
                for part in _own(columns, fold, space):
                    if past:
                        free, side, left, _, basis, place = _split(part, space, past, band)
                        held = np.where(free, 0.0, side)
                        sums += np.concatenate([(held if len(basis) == len(held) else np.bincount(place, held, len(basis))) @ basis, [held.sum(), np.maximum(np.abs(left[~free]) - EPSILON, 0).sum()]])
                        sent = free | (_drawn(part) < share)
                        part = np.column_stack([part, np.where(free, 1.0, 1 / share), held])[sent]
                    else:
                        part = np.column_stack([part, np.ones(len(part)), np.zeros(len(part))])
                    rows.append(part)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([sums.tobytes()], pa.binary()), pa.array([b"".join(r.tobytes() for r in rows)], pa.binary())], names=["key", "sums", "rows"])

    return run


def _ended(spaces, asked: list[tuple]):
    """Of each model asked for: rows, their loss, and what those that were not free add to the duality gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(asked), 3))
        for b in batches:
            fold, columns = _arrays(b)
            for key, (at, past, band, new) in enumerate(asked):
                for part in _own(columns, fold, spaces.value[at]):
                    loss_of = lambda left: np.maximum(np.abs(left) - EPSILON, 0)
                    if not past:
                        left = part[:, 0] - spaces.value[at].predict(part[:, 1:], new)
                        sums[key] += len(part), loss_of(left).sum(), 0.0
                        continue
                    free, side, _, left, _, _ = _split(part, spaces.value[at], past, band, new)
                    loss = loss_of(left)
                    sums[key] += len(part), loss.sum(), (loss + EPSILON * np.abs(side) - side * left)[~free].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked)), pa.int32()), *(pa.array(v) for v in sums.T)], names=["key", "n", "loss", "gap"])

    return run


def interior(space: Space, rows: np.ndarray, pull: np.ndarray, cost: float, loss: float, goal: float) -> tuple[np.ndarray, float, int]:
    """(coordinates and bias, duality gap over these rows, guards that changed sides) of the model of `rows` (te, features,
    weight, side), by a primal-dual interior-point method with Mehrotra's corrector: a few dozen steps, whatever the rows.

    pull, loss: sums of the rows whose multipliers are known (the last one: of the multipliers). Rows of a side are guards:
    they are in these sums, and what they lose beyond that when they change sides counts by their weight. The basis is kept
    up to KEPT_BYTES, else computed again in slices.
    """
    length = max(256, SLICE // max(1, space.width))
    few, place = distinct(rows[:, 1:-2])  # sums of equal rows are taken first
    cuts = [slice(i, i + length) for i in range(0, len(few), length)]
    made = lambda c: np.column_stack([space.whitened(space.basis(few[c])), np.ones(len(few[c]))])
    held = [made(c) for c in cuts] if len(few) * (space.width + 1) * 8 <= KEPT_BYTES else None
    phi = (lambda i: held[i]) if held is not None else (lambda i: made(cuts[i]))
    width, y = space.width, rows[:, 0]
    added = lambda v: v if len(few) == len(rows) else np.bincount(place, v, len(few))
    across = lambda v: np.concatenate([phi(i) @ v for i in range(len(cuts))] or [np.zeros(0)])[place]

    def down(v: np.ndarray) -> np.ndarray:
        v = added(v)
        return sum((phi(i).T @ v[c] for i, c in enumerate(cuts)), np.zeros(width + 1))


    guard, side = rows[:, -1] != 0, rows[:, -1]
    given, loss = pull - cost * down(rows[:, -2] * side), cost * loss
    cost = cost * rows[:, -2]
    w = np.append(np.zeros(width), np.median(y) if len(y) else 0.0)
    ridge = np.append(np.ones(width), 0.0)
    left = y - w[-1]
    sign = np.array([[1.0], [-1.0]])
    t = sign * left - EPSILON  # both sides of the tube
    s, v, a = np.maximum(t, 0) + EPSILON, np.maximum(-t, 0) + EPSILON, np.broadcast_to(cost / 2, t.shape)
    best, since = None, 0
    for _ in range(MOST_STEPS):
        left = t[0] + EPSILON
        off = given + down(a[0] - a[1]) - ridge * w  # dual residual; the last one: multipliers add up to 0
        gap = float((a * v + (cost - a) * s).sum())
        primal = w[:-1] @ w[:-1] / 2 + loss + float((np.maximum(t, 0) * cost)[:, ~guard].sum())
        error = gap + float(np.abs(off) @ np.maximum(np.abs(w), 1.0))
        if best is None or error < best[1]:
            best, since = (w.copy(), error, int((np.sign(left) * (np.abs(left) > EPSILON) != side)[guard].sum())), 0
        else:
            since += 1
        if error <= goal * max(primal, 1e-12) or since == STUCK:
            break
        theta = s / (cost - a) + v / a
        weight = added((1 / theta).sum(0))
        curve = np.zeros((width + 1,) * 2, np.float32)
        for i, c in enumerate(cuts):
            z = (phi(i) * np.sqrt(weight[c])[:, None]).astype(np.float32)
            curve += z.T @ z
        matrix = curve.astype(np.float64) + np.diag(np.append(np.ones(width), 1e-9 * max(1.0, float(curve[-1, -1]))))
        def moved(over: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, ...]:
            """Steps towards a * v = under, (cost - a) * s = over."""
            rho = t - over / (cost - a) + under / a  # noqa: B023
            h = rho / theta  # noqa: B023
            dw = np.linalg.solve(matrix, off + down(h[0] - h[1]))  # noqa: B023
            dt = -sign * across(dw)
            da = (dt + rho) / theta  # noqa: B023
            dv = (under - a * v - v * da) / a  # noqa: B023
            return dw, dt, da, dt + dv, dv

        def far(da: np.ndarray, ds: np.ndarray, dv: np.ndarray) -> float:
            room = 1.0
            for value, change in ((a, da), (cost - a, -da), (s, ds), (v, dv)):  # noqa: B023
                down_ = change < 0
                if down_.any():
                    room = min(room, float((-value[down_] / change[down_]).min()))
            return room

        mu = gap / (2 * t.size)
        _, _, da, ds, dv = moved(np.zeros_like(t), np.zeros_like(t))
        step = far(da, ds, dv)
        ahead = float(((a + step * da) * (v + step * dv) + (cost - a - step * da) * (s + step * ds)).sum()) / (2 * t.size)
        centre = mu * (ahead / mu) ** 3
        dw, dt, da, ds, dv = moved(centre + da * ds, centre - da * dv)
        step = min(1.0, 0.99 * far(da, ds, dv))
        w, a, s, v = w + step * dw, a + step * da, s + step * ds, v + step * dv
        t = t + step * dt
    return best


def _fitted(spaces, asked: list[tuple], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for key, sums, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(key, []).append((sums, rows))
        b = sums = rows = None
        for key in sorted(held):
            parts = sorted(held.pop(key))  # the same sums and order whatever comes first
            at, _, _, _, cost, goal = asked[key]
            space = spaces.value[at]
            space = Space(space.fold, space.means, space.deviations, space.gamma, space.marks, _inverse_root(radial(space.marks, space.marks, space.gamma)))
            sums = sum(np.frombuffer(p[0]) for p in parts) * cost
            rows = np.frombuffer(b"".join(p[1] for p in parts)).reshape(-1, width)
            parts = None
            w, gap, crossed = interior(space, rows, np.append(space.root.T @ sums[:-2], sums[-2]), cost, sums[-1] / cost, goal)
            own = np.append(space.weights(w[:-1]), w[-1])
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([w[:-1] @ w[:-1]]), pa.array([gap]), pa.array([crossed], pa.int64())], names=["key", "w", "norm", "gap", "crossed"])

    return run


def kernel_solved(rows: DataFrame, names: list[str], spaces: list[Space], name: str) -> list[np.ndarray]:
    """What the basis is multiplied with, and the bias, of the model of each space, by models of ever more rows.

    A model of some rows tells on which side of the tube the others will be. Those off its edges have multipliers that are
    known, so they enter as sums; only the rest, which grows with the root of the rows, is gathered and solved for, a task
    for each model, with about GUARDS of the others to bound it. Then all rows are tested: if what they add leaves the duality gap above GAP of the primal value, the
    rows that changed sides are free too, and it is solved again, at worst with all of them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(spaces)
    n, models = max(1, rows.count()), [np.zeros(0)] * len(spaces)
    sizes = [n]
    while sizes[0] > 1.5 * FIRST_ROWS:
        sizes.insert(0, max(FIRST_ROWS, -(-sizes[0] // GROWTH)))
    for level, size in enumerate(sizes):
        whole = level == len(sizes) - 1
        some = rows if whole else rows.filter(F.pmod(F.xxhash64("gene_id", F.lit(11)), F.lit(1 << 30)) < int(size / n * (1 << 30)))
        packed = some.select("fold", "te", *names)
        cost = C * n / size
        band = BAND * (FIRST_ROWS / sizes[level - 1]) ** 0.5
        state = {i: ([models[i]] if level else [], band) for i in range(len(spaces))}
        for turn in range(MOST_ROUNDS):
            asked = [(i, past, wide, min(1.0, GUARDS / size), cost, GAP / 3 if whole and (turn or not past) else 1e-3) for i, (past, wide) in state.items()]
            chosen = packed.mapInArrow(_freed(shared, asked), "key int, sums binary, rows binary").repartitionById(len(asked), F.col("key"))
            got = chosen.mapInArrow(_fitted(shared, asked, len(names) + 3), "key int, w binary, norm double, gap double, crossed long").collect()
            found = {asked[r["key"]][0]: r for r in got}
            for i, r in found.items():
                models[i] = np.frombuffer(r["w"])
            if not whole:
                break
            tested = [(i, past, wide, models[i]) for i, (past, wide) in state.items()]
            sums = packed.mapInArrow(_ended(shared, tested), "key int, n double, loss double, gap double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "loss", "gap")]).collect()
            for r in sums:
                i, past, wide, new = tested[r["key"]]
                primal = found[i]["norm"] / 2 + C * r["loss"]
                if not found[i]["crossed"] and found[i]["gap"] + C * r["gap"] <= GAP * max(primal, 1e-12) or not past:
                    del state[i]
                else:
                    state[i] = ([*past, new], wide * (NARROWER if turn == 0 else 1.0 if turn < 4 else 2.0))
            if not state:
                break
        else:
            warnings.warn(f"{name} has not converged after {MOST_ROUNDS} rounds", RuntimeWarning, stacklevel=2)
    return models


def solved(rows: DataFrame, names: list[str], spaces: list[Space], name: str) -> list[np.ndarray]:
    """Weights of the basis and bias of the model of each space."""
    if spaces[0].marks is not None:
        return kernel_solved(rows, names, spaces, name)
    shared = rows.sparkSession.sparkContext.broadcast(spaces)
    packed = rows.select("fold", "te", *names)
    n = max(1, packed.count())
    models = [Model(i, np.zeros(s.width + 1), share=1.0 if s.width < EXACT_WIDTH else min(1.0, CURVATURE_ROWS * s.width / n)) for i, s in enumerate(spaces)]
    for _ in range(MOST_PASSES):
        still = [(m.at, m.w, m.barrier, m.share) for m in models if not m.done]
        if not still:
            break
        sums = packed.mapInArrow(_partial(shared, still), "at int, head binary, curve binary").groupBy("at").applyInArrow(_added, "at int, head binary, curve binary").collect()
        for r in sums:
            m = models[r["at"]]
            _moved(m, spaces[m.at], np.frombuffer(r["head"]), np.frombuffer(r["curve"], _kind(len(m.w))))
    else:
        warnings.warn(f"{name} has not converged after {MOST_PASSES} passes", RuntimeWarning, stacklevel=2)
    return [m.w for m in models]


def _picks(z: np.ndarray, space: Space, most: int) -> np.ndarray:
    """Rows with the largest residuals outside the landmarks' span, one after the other, each outside that of those before."""
    v = space.whitened(radial(z, space.marks, space.gamma)) if len(space.marks) else np.zeros((len(z), 0))
    left = 1.0 - (v * v).sum(1)
    new, picked = np.zeros((most, len(z))), []
    for k in range(most):
        p = int(left.argmax())
        if left[p] <= RESIDUAL:
            break
        column = radial(z, z[p : p + 1], space.gamma)[:, 0] - v @ v[p] - new[:k, p] @ new[:k]
        new[k] = column / np.sqrt(left[p])
        left = left - new[k] ** 2
        picked.append(p)
    return np.array(picked, np.int64)


def landmarks(rows: DataFrame, names: list[str], means: np.ndarray, deviations: np.ndarray, gamma: float, n: int) -> np.ndarray | None:
    """Rows (as they are) that span the kernel of all rows up to RESIDUAL; None if more than MOST_LANDMARKS would be needed."""
    spark, marks = rows.sparkSession, np.zeros((0, len(names)))
    most = max(16, min(400, PROPOSED // max(1, n // 4096)))
    while True:
        z = (marks - means) / deviations
        space = Space(None, means, deviations, gamma, z, _inverse_root(radial(z, z, gamma)) if len(z) else np.zeros((0, 0)))
        shared = spark.sparkContext.broadcast(space)

        def proposed(batches):
            for b in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                for i in range(0, len(x), 4096):  # noqa: B023
                    part = distinct(x[i : i + 4096])[0]
                    own = part[_picks((part - shared.value.means) / shared.value.deviations, shared.value, most)]  # noqa: B023
                    yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in own], pa.binary())], names=["x"])

        found = rows.select(*names).mapInArrow(proposed, "x binary").distinct().collect()
        if not found:
            return marks
        x = np.array(sorted(np.frombuffer(r["x"]).tolist() for r in found))
        marks = np.vstack([marks, x[_picks((x - means) / deviations, space, min(len(x), MOST_LANDMARKS + 1 - len(marks)))]])
        if len(marks) > MOST_LANDMARKS:
            return None


def spaces_of(rows: DataFrame, names: list[str], folds: list[int | None], kernel: bool, by_fold: dict[int, linear.Moments] | None = None) -> list[Space] | None:
    """The spaces of the models that leave each of the folds out (None: none). None if the kernel has no low rank."""
    by_fold = by_fold or linear.moments(rows, names)
    total = sum(list(by_fold.values())[1:], next(iter(by_fold.values())))
    at, out = list(range(len(names))), []

    def space(fold: int | None) -> Space:
        kept = total if fold is None or len(by_fold) == 1 else total - by_fold[fold]
        cov, _, means, deviations, _ = kept.standardised(at)
        varied = np.trace(cov)  # of standardised features: how many vary
        return Space(None if len(by_fold) == 1 else fold, means, deviations, 1.0 / varied if kernel and varied > 0 else 1.0)

    marks = None
    if kernel:
        whole = space(None)
        marks = landmarks(rows, names, whole.means, whole.deviations, whole.gamma, int(total.n))
        if marks is None:
            return None
    for f in folds:
        s = space(f)
        if kernel:
            s.marks = (marks - s.means) / s.deviations
        out.append(s)
    return out


class Fitted:
    """A model that maps rows to predictions; it carries no more than that takes."""

    def __init__(self, space: Space, w: np.ndarray) -> None:
        self.space = Space(space.fold, space.means, space.deviations, space.gamma, space.marks)
        self.w = np.append(space.weights(w[:-1]), w[-1])
        self.coefficients = w[:-1] if space.marks is None else None

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.space.predict(x, self.w)


def permutation_importance(fitted: Fitted, rows: DataFrame, names: list[str], repeats: int = 5, seed: int = 42) -> np.ndarray:
    """Mean loss of R2 when a column is shuffled, at least 0, over distributed rows.

    Rows are put into a random order; in each repeat a row gets the value of the one that stands a random number of places
    on. One join a repeat serves all columns.
    """
    spark = rows.sparkSession
    order = rows.select("te", *names, F.xxhash64("gene_id", F.lit(seed)).alias("_at")).repartitionByRange(max(1, spark.sparkContext.defaultParallelism), "_at").sortWithinPartitions("_at", *names, "te")
    order = order.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}).persist(StorageLevel.MEMORY_AND_DISK)
    counts = order.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("low")).orderBy("_part").collect()  # one row a partition
    n, ahead = 0, []
    for r in counts:
        ahead.append((r["_part"], n - r["low"]))
        n += r["n"]
    placed = order.join(F.broadcast(spark.createDataFrame(ahead, "_part int, _off long")), "_part").select("te", *names, (F.col("_id") + F.col("_off")).alias("_i"))
    rng = np.random.default_rng(seed)
    steps = [int(v) for v in rng.integers(1, max(2, n), repeats)]
    mean = placed.agg(F.avg("te")).first()[0]

    def losses(batches):
        sums = np.zeros(len(names) + 3)
        for b in batches:
            y, *columns = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            x, moved = np.column_stack(columns[: len(names)]), columns[len(names) :]
            sums[:3] += ((y - fitted.predict(x)) ** 2).sum(), ((y - mean) ** 2).sum(), len(y)
            for j, v in enumerate(moved):
                kept = x[:, j].copy()
                x[:, j] = v
                sums[3 + j] += ((y - fitted.predict(x)) ** 2).sum()
                x[:, j] = kept
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["j", "v"])

    out = np.zeros(len(names))
    for step in steps:
        other = placed.select(((F.col("_i") + step) % n).alias("_i"), *[F.col(c).alias(f"_m{j}") for j, c in enumerate(names)])
        both = placed.join(other, "_i").select("te", *names, *[f"_m{j}" for j in range(len(names))])
        got = {r["j"]: r["v"] for r in both.mapInArrow(losses, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()}
        out += [(got[3 + j] - got[0]) / got[1] if got[1] > 0 else 0.0 for j in range(len(names))]
    order.unpersist()
    return np.maximum(out / repeats, 0.0)
