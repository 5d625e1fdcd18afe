"""Logistic fits of many overlapping training sets on one table in memory whose rows stand in parts.

A part is a run of rows with the same folds, label, stratum and gaps; training sets are unions of parts. So rows carry no weights and
no labels, and what a part adds to a fit is one sum. The inner fits of a fold share one exact fit of all its rows; derivatives of the
loss up to the fifth order at that fit, a table of sums per part, then give the fits of every outer fold and penalty without another
pass over the rows. A fit whose last derivative still moves it by more than the tolerance is finished by Newton steps over its rows.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations_with_replacement, product

import numpy as np

from sigloom.functions import strata
from sigloom.operators import learn, metrics

PART_ROWS = 64  # rows a part must have on average
WIDEST = 5  # features up to which derivatives of the loss are tabled
ORDER = 5
EDGES = 512
SETTLED = 1e-8

Model = tuple[np.ndarray, np.ndarray]  # slopes and offset in the units of ``Parts.z``, fill values in the same units


def area_of(positive: np.ndarray, negative: np.ndarray) -> float | None:
    """ROC area of sorted scores with ties one half; None if a class is missing."""
    if not len(positive) or not len(negative):
        return None
    few, many = sorted((positive, negative), key=len)
    found = int((np.searchsorted(many, few, "left") + np.searchsorted(many, few, "right")).sum())  # neighbours are looked up one after the other
    pairs = 2 * len(positive) * len(negative)
    return (found if few is positive else pairs - found) / pairs


def area(positive: np.ndarray, negative: np.ndarray, score: np.ndarray) -> float | None:
    """ROC area with ties one half; None if a class is missing."""
    return area_of(np.sort(score[positive]), np.sort(score[negative]))


def _points(value: float | None, weight: float) -> float:
    return 0.0 if value is None else weight * max(0.0, (value - 0.5) / 0.5)


def criterion(protocol, stratum: np.ndarray, take: Callable[[np.ndarray], np.ndarray]) -> float:
    """``nested.criterion`` of one table in memory; ``take`` gives the scores where a mask over ``stratum`` holds."""
    pos = stratum == strata.PTSD
    cases = np.sort(take(pos))
    against = lambda m: area_of(cases, np.sort(take(m)))
    if protocol.all_negatives:
        value = against(~pos)
        return 0.0 if value is None else value
    ctrl = _points(against(np.isin(stratum, protocol.controls)), 30.0)
    if protocol.threshold_free:
        return ctrl + _points(against(np.isin(stratum, [n for g in protocol.specific for n in g])), 20.0)
    shares = [float((take(m) >= metrics.DECISION_THRESHOLD).mean()) for g in protocol.specific if (m := np.isin(stratum, g)).any()]
    return ctrl + 20.0 * (1.0 - (sum(shares) / len(shares) if shares else 0.0))


def judged(protocol, stratum: np.ndarray) -> bool:
    """Whether ``nested.criterion`` has a row for a table with these strata."""
    used = [strata.PTSD, *protocol.controls, *([n for g in protocol.specific for n in g] if protocol.threshold_free else [])]
    return bool(stratum.size) and (protocol.all_negatives or bool(np.isin(stratum, used).any()))


def equal_error_shift(z: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """``metrics.equal_error_shift`` of one table in memory; 0 if a class is missing."""
    n_pos, n_neg = positive.sum(), negative.sum()
    if not n_pos or not n_neg:
        return 0.0
    values = np.unique(z[positive | negative])
    miss = n_pos - np.searchsorted(np.sort(z[positive]), values, "right")
    below = np.searchsorted(np.sort(z[negative]), values, "right")
    cuts = np.concatenate([[values[0] - 1], (values[:-1] + values[1:]) / 2, [values[-1] + 1]])
    gap = np.concatenate([[1.0], np.abs(miss / n_pos - below / n_neg)])
    return float(np.median(cuts[gap - gap.min() <= 1e-8 + 1e-5 * gap.min()]))


def logit(p: np.ndarray, edge: float) -> np.ndarray:
    p = np.clip(p, edge, 1 - edge)
    return np.log(p / (1 - p))


def platt(cases: np.ndarray, others: np.ndarray, balanced: bool, start: np.ndarray | None = None) -> np.ndarray:
    """Slope and offset of ``learn.solve_local`` on one column; weights are one number a class."""
    n, n_pos = len(cases) + len(others), len(cases)
    if not n_pos or n_pos == n:
        return np.array([0.0, learn.ONE_CLASS if n_pos else -learn.ONE_CLASS])
    sides = [(cases, 1.0, n / (2 * n_pos) if balanced else 1.0), (others, 0.0, n / (2 * (n - n_pos)) if balanced else 1.0)]
    state = learn.Damped(2, learn.PLATT_C, 1e-8, start)
    for _ in range(learn.MAX_STEPS):
        loss, g, h = 0.0, np.zeros(2), np.zeros(3)
        for x, y, w in sides:
            for low in range(0, len(x), learn.CACHED_ROWS):
                xs = x[low : low + learn.CACHED_ROWS]
                v = state.beta[0] * xs + state.beta[1]
                soft, p, q = _logistic(v)
                loss += w * (soft - y * float(v.sum()))
                p -= y
                qx = q * xs
                g += w * np.array([p @ xs, p.sum()])
                h += w * np.array([qx @ xs, qx.sum(), q.sum()])
        if state.advance(loss, g, h[[0, 1, 1, 2]].reshape(2, 2)):
            return state.beta
    raise RuntimeError("the logistic fit did not converge")


def _logistic(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of log(1 + exp(v)), the probabilities, and their derivatives."""
    e = np.exp(-np.abs(v))
    r = 1.0 / (1.0 + e)
    soft = float(np.maximum(v, 0.0).sum() - np.log(r).sum())
    return soft, np.where(v >= 0, r, e * r), e * r * r


class Monomials:
    """Products of up to ``ORDER`` features, and where the entries of each derivative find theirs."""

    def __init__(self, p: int) -> None:
        names = [c for d in range(ORDER + 1) for c in combinations_with_replacement(range(p), d)]
        at = {c: i for i, c in enumerate(names)}
        self.steps = [(at[c[:-1]], c[-1]) for c in names[1:]]  # each is an earlier one times a feature
        self.size = len(names)
        self.index = [
            np.array([at[tuple(sorted(i for i in which if i < p))] for which in product(range(p + 1), repeat=m)]).reshape((p + 1,) * m) for m in range(1, ORDER + 1)
        ]

    def of(self, z: np.ndarray) -> np.ndarray:
        out = np.empty((self.size, z.shape[1]))
        out[0] = 1.0
        for i, (parent, j) in enumerate(self.steps, 1):
            np.multiply(out[parent], z[j], out=out[i])
        return out


class Parts:
    """The features ``names`` of a table in parts: ``start`` holds the borders of the parts, ``missing`` says which features a part lacks."""

    def __init__(self, x: np.ndarray, start: np.ndarray) -> None:
        self.start, self.size = start, np.diff(start)
        self.p = x.shape[1]
        self.missing = np.isnan(x[start[:-1]])
        self.centre, self.spread, self.z = np.zeros(self.p), np.ones(self.p), np.ones((self.p + 1, len(x)))  # the last is the offset's
        for j in range(self.p):
            own = x[:, j]
            there = ~np.isnan(own)
            if there.any():
                self.centre[j] = own[there].mean()
                self.spread[j] = own[there].std() or 1.0
            self.z[j] = np.where(there, (own - self.centre[j]) / self.spread[j], 0.0)
        self.count = np.where(self.missing, 0, self.size[:, None]).astype(float)
        self.first = np.add.reduceat(self.z[:-1], start[:-1], axis=1).T
        self.second = np.add.reduceat(self.z[:-1] ** 2, start[:-1], axis=1).T
        part = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.sorted = [self._sorted(j, part) for j in range(self.p)]
        self._count_kinds()

    def _count_kinds(self) -> None:
        """Parts with the same gaps share what filled features do to them."""
        self.kinds, kind = np.unique(self.missing, axis=0, return_inverse=True)
        self.kind = kind.ravel()
        self.monomials = Monomials(self.p) if self.p <= WIDEST else None

    def only(self, columns: Sequence[int]) -> Parts:
        """The same rows with some features; what is in order stays shared."""
        out, columns = copy.copy(self), list(columns)
        out.p = len(columns)
        out.missing, out.count, out.first, out.second = (a[:, columns] for a in (self.missing, self.count, self.first, self.second))
        out.centre, out.spread, out.z = self.centre[columns], self.spread[columns], self.z[[*columns, self.p]]
        out.sorted = [self.sorted[j] for j in columns]
        out._count_kinds()
        return out

    def _sorted(self, j: int, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Present values in order, their parts, borders of slices, and how many rows of each part stand before a border."""
        there = np.flatnonzero(~self.missing[part, j])
        there = there[np.argsort(self.z[j, there])]
        owner = part[there]
        borders = np.linspace(0, len(there), EDGES + 1).astype(int)
        upto = np.zeros((len(self.size), EDGES + 1))
        for k in range(EDGES):
            upto[:, k + 1] = upto[:, k] + np.bincount(owner[borders[k] : borders[k + 1]], minlength=len(self.size))
        return self.z[j, there], owner, borders, upto

    def medians(self, mask: np.ndarray) -> np.ndarray:
        """Median of the present values of the parts in ``mask`` per feature; what the value 0 is where there is none."""
        out = np.empty(self.p)
        for j, (values, owner, borders, upto) in enumerate(self.sorted):
            reached = mask.astype(float) @ upto
            n = int(reached[-1])
            found = []
            for k in {(n - 1) // 2, n // 2} if n else ():
                at = int(np.searchsorted(reached, k, "right")) - 1
                mine = np.flatnonzero(mask[owner[borders[at] : borders[at + 1]]])
                found.append(values[borders[at] + mine[k - int(reached[at])]])
            out[j] = sum(found) / len(found) if n else -self.centre[j] / self.spread[j]
        return out

    def standard(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fill, mean and population deviation of the parts in ``mask``, in units of ``z``."""
        n, fill = self.size[mask].sum(), self.medians(mask)
        gap = n - self.count[mask].sum(axis=0)
        first, second = self.first[mask].sum(axis=0) + gap * fill, self.second[mask].sum(axis=0) + gap * fill**2
        mean = first / n
        var = second / n - mean**2
        sd = np.sqrt(np.where(var > 1e-12 * second / n, var, 0.0))
        return fill, mean, np.where(sd > 0, sd, 1.0)

    def taken(self, values: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The values of the rows of the parts in ``mask``; ``values`` has one a row of the table."""
        own = [values[self.start[q] : self.start[q + 1]] for q in np.flatnonzero(mask)]
        return np.concatenate(own) if own else values[:0]

    def _rows(self, mask: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Parts and their rows, a few at a time so that they stay in the cache."""
        for q in np.flatnonzero(mask):
            for low in range(self.start[q], self.start[q + 1], learn.CACHED_ROWS):
                yield q, slice(low, min(low + learn.CACHED_ROWS, self.start[q + 1]))

    def predict(self, mask: np.ndarray, model: Model, out: np.ndarray, hidden: Sequence[int] = ()) -> None:
        """Writes the probabilities of the rows of the parts in ``mask``, equal ones for equal rows; ``hidden`` features count as missing."""
        beta, fill = model
        gone = self.missing.copy()
        gone[:, list(hidden)] = True
        for q, rows in self._rows(mask):
            v = np.full(rows.stop - rows.start, -(beta[-1] + float(beta[:-1][gone[q]] @ fill[gone[q]])))
            for j in np.flatnonzero(~gone[q]):
                v -= beta[j] * self.z[j, rows]
            np.exp(v, out=v)
            v += 1.0
            np.divide(1.0, v, out=out[rows])

    def filled(self, fill: np.ndarray) -> list[np.ndarray]:
        """Slopes and offset as the rows of each kind see them: a filled feature moves their offset."""
        ups = []
        for missing in self.kinds:
            up, gone = np.eye(self.p + 1), np.flatnonzero(missing)
            up[gone, gone] = 0.0
            up[-1, gone] = fill[gone]
            ups.append(up)
        return ups

    def newton(self, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray, fill: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian of the weighted parts in slopes and offset."""
        ups, d = self.filled(fill), self.p + 1
        seen = [up @ beta for up in ups]
        loss, grads, hesses = 0.0, np.zeros((len(ups), d)), np.zeros((len(ups), d, d))
        for q, rows in self._rows(mask):
            z, k, w = self.z[:, rows], self.kind[q], weight[q]
            v = seen[k] @ z
            soft, p, h = _logistic(v)
            grad = z @ p
            if y[q] == 1:
                soft -= float(v.sum())
                grad -= z.sum(axis=1)
            loss += w * soft
            grads[k] += w * grad
            hesses[k] += w * ((z * h) @ z.T)
        return loss, sum(up.T @ g for up, g in zip(ups, grads)), sum(up.T @ h @ up for up, h in zip(ups, hesses))

    def derivatives(self, mask: np.ndarray, y: np.ndarray, beta: np.ndarray, fill: np.ndarray) -> np.ndarray:
        """Per part the sums of the first ``ORDER`` derivatives of its loss times the monomials of its rows."""
        out = np.zeros((len(self.size), ORDER, self.monomials.size))
        seen = [up @ beta for up in self.filled(fill)]
        for q, rows in self._rows(mask):
            _, p, h = _logistic(seen[self.kind[q]] @ self.z[:, rows])
            turn = 1.0 - 2.0 * p
            out[q] += np.stack([p - y[q], h, h * turn, h * (1.0 - 6.0 * h), h * turn * (1.0 - 12.0 * h)]) @ self.monomials.of(self.z[:-1, rows]).T
        return out


class Fits:
    """Fits of one setting under one labelling of the parts: label ``y``, allowed in training, and own weight per part."""

    def __init__(self, parts: Parts, y: np.ndarray, may: np.ndarray, own: np.ndarray) -> None:
        self.parts, self.y, self.may, self.own = parts, y, may, own

    def weights(self, mask: np.ndarray) -> np.ndarray | None:
        """Weight per part that gives both classes the same total; None where one is missing."""
        mass = np.where(mask, self.own * self.parts.size, 0.0)
        cases = mass[self.y == 1].sum()
        if not (mask & (self.y == 1)).any() or not (mask & (self.y != 1)).any():
            return None
        return np.where(mask, self.own * np.where(self.y == 1, mass.sum() / (2 * cases), mass.sum() / (2 * (mass.sum() - cases))), 0.0)

    def one_class(self, mask: np.ndarray, fill: np.ndarray) -> Model:
        only = bool(mask.any()) and bool((self.y[mask] == 1).all())
        return np.append(np.zeros(self.parts.p), learn.ONE_CLASS if only else -learn.ONE_CLASS), fill

    def exact(self, mask: np.ndarray, cs: Sequence[float], start: np.ndarray | None = None) -> list[Model]:
        """``learn.solve_local`` on the rows of the parts in ``mask`` for each penalty, from slopes and offset ``start`` on."""
        mask = mask & self.may
        if not mask.any():
            return [self.one_class(mask, -self.parts.centre / self.parts.spread)] * len(cs)
        fill, mean, sd = self.parts.standard(mask)
        w = self.weights(mask)
        if w is None:
            return [self.one_class(mask, fill)] * len(cs)
        back = np.diag(np.append(1.0 / sd, 1.0))  # from standardised to own units
        back[-1, :-1] = -mean / sd
        out = []
        for c in cs:
            state = learn.Damped(self.parts.p + 1, c, SETTLED, None if start is None else np.linalg.solve(back, start))
            for _ in range(learn.MAX_STEPS):
                loss, grad, hess = self.parts.newton(mask, self.y, w, back @ state.beta, fill)
                if state.advance(loss, back.T @ grad, back.T @ hess @ back):
                    break
            else:
                raise RuntimeError("the logistic fit did not converge")
            start = back @ state.beta
            out.append((start, fill))
        return out

    def near(self, base: np.ndarray, masks: Sequence[np.ndarray], cs: Sequence[float], start: np.ndarray | None = None, again: bool = True) -> list[list[Model]]:
        """Fits of the training sets ``masks`` inside ``base`` for each penalty; one too far from the fit of ``base`` gets its own expansion."""
        base = base & self.may
        if self.parts.monomials is None or self.weights(base) is None:
            return [self.exact(m, cs, start) for m in masks]
        ((beta, fill),) = self.exact(base, [sorted(cs)[len(cs) // 2]], start)
        table = self.parts.derivatives(base, self.y, beta, fill)
        seen = [up @ beta for up in self.parts.filled(fill)]
        out = []
        for mask in masks:
            m = mask & self.may
            w = self.weights(m)
            if w is None:
                out.append(self.exact(m, cs))
                continue
            own_fill, _, sd = self.parts.standard(m)
            views = []
            for i, (up, there) in enumerate(zip(self.parts.filled(own_fill), seen, strict=True)):
                k = np.flatnonzero(m & (self.parts.kind == i))
                sums = np.tensordot(w[k], table[k], 1)
                views.append((up, there, [sums[n][at] for n, at in enumerate(self.parts.monomials.index)]))
            found = [self._expanded(views, beta, sd, c) for c in cs]
            if all(settled for _, settled in found):
                out.append([(b, own_fill) for b, _ in found])
            elif again:
                out += self.near(m, [m], cs, found[len(cs) // 2][0], False)
            else:
                out.append([(b, own_fill) if settled else self.exact(m, [c], b)[0] for c, (b, settled) in zip(cs, found, strict=True)])
        return out

    def _expanded(self, views: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]], base: np.ndarray, sd: np.ndarray, c: float) -> tuple[np.ndarray, bool]:
        """Minimum of the expanded loss around ``base``, and whether its last derivative no longer matters."""
        ridge, beta = np.append(sd**2, 0.0), base
        for _ in range(50):
            grad, hess, last = np.zeros(len(base)), np.zeros((len(base), len(base))), np.zeros(len(base))
            for up, there, (t1, t2, t3, t4, t5) in views:
                d = up @ beta - there
                t5d = t5 @ d
                t5dd = t5d @ d
                grad += up.T @ (t1 + (t2 + (t3 / 2 + (t4 / 6 + t5d / 24) @ d) @ d) @ d)
                hess += up.T @ (t2 + (t3 + (t4 / 2 + t5d / 6) @ d) @ d) @ up
                last += up.T @ (t5dd @ d @ d / 24)
            system = c * hess + np.diag(ridge + 1e-12)
            try:
                step, tail = np.linalg.solve(system, np.column_stack([c * grad + ridge * beta, c * last])).T
            except np.linalg.LinAlgError:
                return base, False
            beta = beta - step
            moved = np.max(np.abs(step))
            if not np.isfinite(moved) or moved > 1e3:
                return base, False
            if moved < 1e-13 * (1 + np.max(np.abs(beta))):
                break
        else:
            if moved > 1e-11 * (1 + np.max(np.abs(beta))):
                return base, False
        if np.max(np.abs(tail)) < SETTLED * (1 + np.max(np.abs(beta))):
            return beta, True
        near = all(np.max(np.abs(up @ beta - there)) < 1.0 for up, there, _ in views)
        return (beta if near else base), False


def settings(protocol) -> list[tuple[str, str, float, list[int]]]:
    """Feature set, negatives, weight, and the candidates that share them, which differ by penalty alone."""
    shared: dict[tuple[str, str, float], list[int]] = {}
    for i, c in enumerate(protocol.candidates):
        shared.setdefault((c.features, c.negatives, c.spec_weight), []).append(i)
    return [(*k, shared[k]) for k in sorted(shared)]
