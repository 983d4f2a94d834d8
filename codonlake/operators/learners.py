"""Regressors that need the rows themselves: boosted trees, random forest, support vector regression; plain numpy.

Tree ensembles follow the published algorithms (histogram splits, leaf-wise or depth-wise growth), not any library bit
for bit. Everything is deterministic for a seed.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import count

import numpy as np

BINS = 64
#: Rows of a node up to which sums by code are counted and not taken from those of the node above.
DIRECT = 4096


def binned(x: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes of the rows and the upper bounds of the bins of each column."""
    codes, cuts = np.empty(x.shape, np.uint8), []
    for j in range(x.shape[1]):
        distinct = np.unique(x[:, j])
        edges = (distinct[1:] + distinct[:-1]) / 2 if len(distinct) <= bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
        cuts.append(edges)
        codes[:, j] = np.searchsorted(edges, x[:, j], "left")
    return codes, cuts


def coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(edges, x[:, j], "left").astype(np.uint8) for j, edges in enumerate(cuts)])


def cells(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct row of codes, place of each row's among them). Trees cannot tell rows of a cell apart, so a
    cell stands for them by number and sum. Beyond eight columns equal rows are rare, and each row is its own cell.
    """
    n, width = codes.shape
    if width > 8:
        return np.arange(n), np.arange(n)
    packed = np.zeros((n, 8), np.uint8)
    packed[:, :width] = codes
    _, first, place = np.unique(packed.view(np.uint64).ravel(), return_index=True, return_inverse=True)
    return first, place


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    code: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for part, v in ((self.feature, -1), (self.code, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            part.append(v)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        while True:
            f = feature[at]
            open_ = np.flatnonzero(f >= 0)
            if not len(open_):
                return np.array(self.value)[at]
            goes = x[open_, f[open_]] <= cut[at[open_]]
            at[open_] = np.where(goes, left[at[open_]], right[at[open_]])

    def dealt(self, columns: list[np.ndarray]) -> np.ndarray:
        """Values of rows that are given by the codes of each column: rows are dealt out from node to node."""
        out, open_ = np.empty(len(columns[0])), [(0, np.arange(len(columns[0])))]
        while open_:
            node, part = open_.pop()
            if self.feature[node] < 0:
                out[part] = self.value[node]
                continue
            goes = columns[self.feature[node]].take(part) <= self.code[node]
            open_ += [(self.left[node], part[goes]), (self.right[node], part[~goes])]
        return out


def grow(codes, cuts, grad, rows, features, gains, *, leaves: int, depth: int, least: int, ridge: float, weight=None) -> tuple[Tree, list[tuple[int, np.ndarray]]]:
    """A tree for squared error with residuals `grad`, best leaf first; adds each split's gain to `gains`.

    weight: how many rows each one stands for (0: none, it is only put into its leaf), with `grad` their mean. Of a split
    node's sums by code those of the smaller child are counted, the other's are the rest. They are counted too up to DIRECT
    rows, and where several splits are equal but for the rounding of the rest.
    """
    tree, width = Tree(), BINS + 1
    pulled = grad if weight is None else grad * weight
    columns = [codes[:, j] for j in features]
    idle = weight is not None and not weight.all()
    spread = 1e-12 * float(np.abs(pulled).sum() * np.abs(grad).max(initial=0.0))  # more than rounding moves a gain

    def table(part: np.ndarray, pull: np.ndarray) -> np.ndarray:
        """Rows and sums of each (feature, code)."""
        held = None if weight is None else weight.take(part)
        out = np.empty((2, len(columns), width))
        for i, column in enumerate(columns):
            code = column.take(part).astype(np.intp)
            out[0, i] = np.bincount(code, held, width)
            out[1, i] = np.bincount(code, pull, width)
        return out

    def rest(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = whole - part
        out[1][out[0] == 0] = 0.0  # codes without rows leave sums as they are
        return out

    def split_of(sums_by_code: np.ndarray, n: float, total: float, counted: bool):
        counts, sums = sums_by_code.cumsum(2)
        ok = (counts >= least) & (n - counts >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, sums**2 / (counts + ridge) + (total - sums) ** 2 / (n - counts + ridge) - total**2 / (n + ridge), -1.0)
        best = int(gain.argmax())
        i, b = divmod(best, width)
        if not counted:
            near = np.nonzero(gain >= gain.flat[best] - spread - 1e-9 * (abs(gain.flat[best]) + total**2 / (n + ridge)))
            if (near[0] != i).any() or (counts[near] != counts[i, b]).any():
                return ()
        return (float(gain.flat[best]), i, b, float(counts[i, b])) if gain.flat[best] > 1e-12 else None

    def opened(parts: list[np.ndarray], sizes: list[float], level: int, whole: np.ndarray | None, last: bool) -> list[list]:
        """The nodes of a split, or the root: [gain, node, rows, level, split, sums by code, size]."""
        pulls = [pulled.take(part) for part in parts]
        wanted = [level < depth and n >= 2 * least and not last for n in sizes]
        tables: list[np.ndarray | None] = [None] * len(parts)
        rests = [False] * len(parts)
        small = min(range(len(parts)), key=lambda i: len(parts[i]))
        for i in sorted(range(len(parts)), key=lambda i: i != small):
            rests[i] = wanted[i] and i != small and len(parts[i]) > DIRECT
            if rests[i]:
                tables[i] = rest(whole, table(parts[small], pulls[small]) if tables[small] is None else tables[small])
            elif wanted[i]:
                tables[i] = table(parts[i], pulls[i])
        out = []
        for part, pull, n, own, taken in zip(parts, pulls, sizes, tables, rests, strict=True):
            total = (pull[weight.take(part) > 0] if idle else pull).sum()
            found = None if own is None else split_of(own, n, total, not taken)
            if found == ():
                own = table(part, pull)
                found = split_of(own, n, total, True)
            out.append([found[0] if found else -1.0, tree.add(float(total / (n + ridge))), part, level, found, own, n])
        return out

    open_ = opened([rows], [len(rows) if weight is None else float(weight[rows].sum())], 0, None, leaves < 2)
    done = []
    while open_ and len(open_) + len(done) < leaves:
        best = max(range(len(open_)), key=lambda i: open_[i][0])
        gain, node, part, level, found, own, n = open_.pop(best)
        if not found:
            done.append((node, part))
            continue
        _, i, b, held = found
        j = int(features[i])
        gains[j] += gain
        goes = columns[i].take(part) <= b
        made = opened([part[goes], part[~goes]], [held, n - held], level + 1, own, len(open_) + len(done) + 2 >= leaves)
        tree.feature[node], tree.code[node], tree.cut[node], tree.left[node], tree.right[node] = j, b, float(cuts[j][b]), made[0][1], made[1][1]
        open_ += made
    return tree, done + [(o[1], o[2]) for o in open_]


def grow_levels(codes, cuts, y, rows, gains, *, k: int, depth: int, rng, weight=None, seen: tuple[np.ndarray, np.ndarray] | None = None) -> Tree:
    """A tree with any number of leaves, a level at a time; each node takes the best split of `k` random features.

    weight: how many rows each one stands for, with `y` their mean. seen: codes of other rows, which go down the levels as
    these are made, and an array that their values are added to.
    """
    width, p = BINS + 1, codes.shape[1]
    held = np.ones(len(rows)) if weight is None else weight[rows]
    codes, y, pull = np.ascontiguousarray(codes[rows]), y[rows], held * y[rows]
    bounds = np.zeros((p, width))
    for j, edges in enumerate(cuts):
        bounds[j, : len(edges)] = edges
    own = np.zeros(len(y), np.int64)  # place of the row's node among the open ones
    n, total, made = np.bincount(own, held), np.bincount(own, pull), 1
    levels = [[np.array([-1]), np.zeros(1), np.array([-1]), np.array([np.average(y, weights=held)])]]  # feature, cut, left, value
    if seen is not None:
        down, at, value_of = np.arange(len(seen[0])), np.zeros(len(seen[0]), np.int64), np.full(len(seen[0]), levels[0][3][0])
    for _ in range(depth):
        m, wide = len(n), len(n) * width <= 4 * len(own)
        off = held * (y - (total / n)[own])
        picked = np.argsort(rng.random((m, p)), 1)[:, :k]
        gain, feature, code = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        alone = np.bincount(own, minlength=m) < 2  # nothing to split
        if not alone.all():
            open_ = np.flatnonzero(~alone[own])
            node, held_, off = own[open_], held[open_], off[open_]
            for s in range(k):
                key = node * width + codes.ravel().take(open_ * p + picked[:, s].take(node))
                if wide:  # a table of all (node, code)
                    counts, sums = np.bincount(key, held_, m * width), np.bincount(key, off, m * width)
                    place = np.flatnonzero(counts)
                    counts, sums = counts[place], sums[place]
                else:
                    bits = max(1, int(len(key) - 1).bit_length())
                    packed = np.sort(key << bits | np.arange(len(key)))
                    order, key = packed & (1 << bits) - 1, packed >> bits
                    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    place, counts, sums = key[start], np.add.reduceat(held_[order], start), np.add.reduceat(off[order], start)
                who = place // width
                begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                which = who[begin]  # nodes with more than one row
                upto, part = np.cumsum(counts), np.cumsum(sums)
                size = np.diff(np.append(begin, len(who)))
                left = upto - np.repeat(np.append(0.0, upto[begin[1:] - 1]), size)
                part = part - np.repeat(np.append(0.0, part[begin[1:] - 1]), size)
                right = n[who] - left
                value = np.where(right > 0.5, part**2 * (1 / left + 1 / np.maximum(right, 1)), -1.0)
                top = np.maximum.reduceat(value, begin)
                best = np.flatnonzero(value == np.repeat(top, size))
                best = best[np.append(True, who[best[1:]] != who[best[:-1]])]  # the lowest cut of equal ones
                better = top > gain[which]
                to = which[better]
                gain[to], feature[to], code[to] = top[better], picked[to, s], place[best][better] % width
        split = gain > 1e-12
        if not split.any():
            break
        np.add.at(gains, feature[split], gain[split])
        first = 2 * (np.cumsum(split) - 1)
        levels[-1][0][split], levels[-1][1][split], levels[-1][2][split] = feature[split], bounds[feature[split], code[split]], made + first[split]
        if not split.all():
            keep = np.flatnonzero(split[own])
            codes, y, held, pull, own = (v.take(keep, 0) for v in (codes, y, held, pull, own))
        goes = codes.ravel().take(np.arange(0, len(own) * p, p) + feature[own]) <= code[own]
        own = first[own] + ~goes
        size = 2 * int(split.sum())
        n, total = np.bincount(own, held, size), np.bincount(own, pull, size)
        levels.append([np.full(size, -1), np.zeros(size), np.full(size, -1), total / n])
        made += size
        if seen is not None:
            stay = split[at]
            down, at = down[stay], at[stay]
            at = first[at] + ~(seen[0][down, feature[at]] <= code[at])
            value_of[down] = levels[-1][3][at]
    if seen is not None:
        np.add(seen[1], value_of, out=seen[1])
    feature, cut, left, value = (np.concatenate(parts) for parts in zip(*levels, strict=True))
    return Tree(feature, np.full(made, -1), cut, left, np.where(left >= 0, left + 1, -1), value)


def _means(place: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each cell and their mean (0 for none)."""
    weight = np.bincount(place, minlength=n).astype(float)
    return weight, np.bincount(place, y, n) / np.maximum(weight, 1)


class Boosted:
    """Gradient boosting for squared error."""

    def __init__(self, rounds: int, rate: float = 0.05, leaves: int = 63, depth: int = 64, least: int = 20, ridge: float = 0.0, rows: float = 1.0, columns: float = 0.8, normalised: bool = False, seed: int = 42) -> None:
        self.p = {"rounds": rounds, "rate": rate, "leaves": leaves, "depth": depth, "least": least, "ridge": ridge, "rows": rows, "columns": columns, "seed": seed}
        self.normalised = normalised

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p, rng = self.p, np.random.default_rng(self.p["seed"])
        codes, self.cuts = binned(x)
        first, place = cells(codes)
        codes, every = np.asfortranarray(codes[first]), np.arange(len(first))
        gains, used = np.zeros(x.shape[1]), np.zeros(x.shape[1])
        self.base, self.trees = float(y.mean()), []
        f = np.full(len(first), self.base)
        weight, mean = _means(place, y, len(first))
        for _ in range(p["rounds"]):
            if p["rows"] < 1:
                rows = rng.choice(len(y), max(1, int(p["rows"] * len(y))), replace=False)
                weight, mean = _means(place[rows], y[rows], len(first))
            cols = np.sort(rng.choice(x.shape[1], max(1, int(round(p["columns"] * x.shape[1]))), replace=False))
            own = np.zeros_like(gains)
            tree, parts = grow(codes, self.cuts, mean - f, every, cols, own, leaves=p["leaves"], depth=p["depth"], least=p["least"], ridge=p["ridge"], weight=weight)
            gains += own
            used += np.bincount([j for j in tree.feature if j >= 0], minlength=len(used))
            self.trees.append(tree)
            for node, part in parts:
                f[part] += p["rate"] * tree.value[node]
        if self.normalised:  # average gain of a split, as shares
            mean = gains / np.maximum(used, 1)
            gains = mean / mean.sum() if mean.sum() > 0 else mean
        self.importance = gains
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = coded(x, self.cuts)
        first, place = cells(codes)
        columns = list(np.ascontiguousarray(codes[first].T))
        return (self.base + self.p["rate"] * sum((t.dealt(columns) for t in self.trees), np.zeros(len(first))))[place]


class Forest:
    """Bootstrapped trees, a random root-sized set of features at each split, importances as shares of all gains.

    A tree has about as many nodes as there are rows. foretold() adds up each tree's predictions while it grows and keeps
    none of them, so that the memory is that of one tree, however many are grown.
    """

    def __init__(self, trees: int = 300, depth: int = 1 << 20, seed: int = 42) -> None:
        self.n, self.depth, self.seed = trees, depth, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.trees = list(self._grown(x, y, None))
        return self

    def foretold(self, x: np.ndarray, y: np.ndarray, other: np.ndarray) -> np.ndarray:
        """What fit(x, y).predict(other) would be."""
        codes, cuts = binned(x)
        seen = coded(other, cuts)
        first, place = cells(seen)
        total = np.zeros(len(first))
        for _ in self._grown(x, y, (seen[first], total), (codes, cuts)):
            pass
        return (total / self.n)[place]

    def _grown(self, x: np.ndarray, y: np.ndarray, seen: tuple[np.ndarray, np.ndarray] | None, given: tuple[np.ndarray, list[np.ndarray]] | None = None) -> Iterator[Tree]:
        rng = np.random.default_rng(self.seed)
        codes, cuts = given or binned(x)
        first, place = cells(codes)
        codes = codes[first]
        total = np.zeros(x.shape[1])
        k = max(1, int(np.sqrt(x.shape[1])))
        for _ in range(self.n):
            rows = rng.integers(0, len(y), len(y))
            weight, mean = _means(place[rows], y[rows], len(first))
            own = np.zeros(x.shape[1])
            tree = grow_levels(codes, cuts, mean, np.flatnonzero(weight), own, k=k, depth=self.depth, rng=rng, weight=weight, seen=seen)
            total += own / max(own.sum(), 1e-300)
            yield tree
        self.cuts, self.importance = cuts, total / max(total.sum(), 1e-300)

    def predict(self, x: np.ndarray) -> np.ndarray:
        first, place = cells(coded(x, self.cuts))
        return (sum((t.predict(x[first]) for t in self.trees), np.zeros(len(first))) / len(self.trees))[place]


class Scaled:
    """Centres and scales by the training rows' population deviation, then fits what it wraps."""

    def fit(self, x: np.ndarray, y: np.ndarray):
        self.mean, dev = x.mean(0), x.std(0)
        self.dev = np.where(dev > 0, dev, 1.0)
        self._fit((x - self.mean) / self.dev, y)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._predict((x - self.mean) / self.dev)


def _unfinished(name: str, after: str) -> None:
    warnings.warn(f"{name} has not converged after {after}", RuntimeWarning, stacklevel=2)


class KernelSVR(Scaled):
    """Epsilon regression with a radial kernel; pairs of the largest violation are optimised in turn (SMO)."""

    #: Bytes of kernel rows that are kept; others are computed when they are needed.
    KERNEL_BYTES = 256 << 20

    def __init__(self, c: float = 1.0, epsilon: float = 0.1, tolerance: float = 1e-3, most: int | None = None) -> None:
        self.c, self.epsilon, self.tolerance, self.most = c, epsilon, tolerance, most

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.exp(-self.gamma * np.maximum(d, 0))

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        n, c = len(y), self.c
        spread = x.var()
        self.gamma = 1.0 / (x.shape[1] * spread) if spread > 0 else 1.0
        row = lru_cache(max(2, self.KERNEL_BYTES // (8 * n)))(lambda p: self._kernel(x[p : p + 1], x)[0])
        sign = np.concatenate([np.ones(n), -np.ones(n)])
        a = np.zeros(2 * n)
        g = np.concatenate([self.epsilon - y, self.epsilon + y])  # gradient of the dual
        for done in count():
            up = ((a < c) & (sign > 0)) | ((a > 0) & (sign < 0))
            low = ((a < c) & (sign < 0)) | ((a > 0) & (sign > 0))
            v = -sign * g
            i = int(np.where(up, v, -np.inf).argmax())
            j = int(np.where(low, v, np.inf).argmin())
            if v[i] - v[j] < self.tolerance:
                break
            if done == self.most:
                _unfinished("SVR", f"{done} steps")
                break
            p, q = i % n, j % n
            kp, kq = row(p), row(q)
            curve = max(kp[p] + kq[q] - 2 * kp[q], 1e-12)
            step = (v[i] - v[j]) / curve
            step = min(step, c - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else c - a[j])
            a[i] += sign[i] * step
            a[j] -= sign[j] * step
            delta = step * (kp - kq)
            g += sign * np.concatenate([delta, delta])
        v = -sign * g
        free = (a > 1e-12) & (a < c - 1e-12)
        up = ((a < c) & (sign > 0)) | ((a > 0) & (sign < 0))
        low = ((a < c) & (sign < 0)) | ((a > 0) & (sign > 0))
        self.bias = float(v[free].mean()) if free.any() else float((v[up].max() + v[low].min()) / 2)
        beta = a[:n] - a[n:]
        self.beta, self.x = beta[beta != 0], x[beta != 0]

    def _predict(self, x: np.ndarray) -> np.ndarray:
        step = max(1, self.KERNEL_BYTES // (8 * max(1, len(self.x))))
        parts = [self._kernel(x[at : at + step], self.x) @ self.beta for at in range(0, len(x), step)]
        return np.concatenate(parts) + self.bias if parts else np.zeros(0)


class LinearSVR(Scaled):
    """L2-regularised epsilon regression, intercept regularised too, by dual coordinate descent (Ho and Lin 2012)."""

    def __init__(self, c: float = 1.0, epsilon: float = 0.1, most: int = 10_000, tolerance: float = 1e-4, seed: int = 42) -> None:
        self.c, self.epsilon, self.most, self.tolerance, self.seed = c, epsilon, most, tolerance, seed

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        z = np.column_stack([x, np.ones(len(x))])
        w, beta, norm = np.zeros(z.shape[1]), np.zeros(len(y)), (z * z).sum(1)
        rng = np.random.default_rng(self.seed)
        for _ in range(self.most):
            change = 0.0
            for i in rng.permutation(len(y)):
                slope = z[i] @ w - y[i]
                t = beta[i] - slope / norm[i]
                new = np.sign(t) * max(abs(t) - self.epsilon / norm[i], 0.0)
                new = min(max(new, -self.c), self.c)
                if new != beta[i]:
                    w += (new - beta[i]) * z[i]
                    change = max(change, abs(new - beta[i]))
                    beta[i] = new
            if change < self.tolerance:
                break
        else:
            _unfinished("LinearSVM", f"{self.most} passes")
        self.coefficients, self.bias = w[:-1], w[-1]

    def _predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coefficients + self.bias


def make(name: str, scale: float = 1.0):
    """A model by its name; scale shrinks the number of trees or rounds for small runs."""
    n = lambda full: max(2, int(full * scale))
    models = {
        "RandomForest": lambda: Forest(n(300)),
        "LightGBM": lambda: Boosted(n(1000)),
        "XGBoost": lambda: Boosted(n(300), leaves=64, depth=6, least=1, ridge=1.0, rows=0.8, normalised=True),
        "SVR": KernelSVR,
        "LinearSVM": LinearSVR,
    }
    if name not in models:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(models)}")
    return models[name]()


def permutation_importance(model, x: np.ndarray, y: np.ndarray, repeats: int = 5, seed: int = 42) -> np.ndarray:
    """Mean loss of R2 when a column is shuffled, at least 0."""
    if x is None or y is None:
        raise ValueError("permutation importance needs the rows")

    def r2(p):
        spread = ((y - y.mean()) ** 2).sum()
        return 1 - ((y - p) ** 2).sum() / spread if spread > 0 else 0.0

    rng, base = np.random.default_rng(seed), r2(model.predict(x))
    out = np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        for _ in range(repeats):
            moved = x.copy()
            moved[:, j] = rng.permutation(moved[:, j])
            out[j] += base - r2(model.predict(moved))
    return np.maximum(out / repeats, 0.0)
