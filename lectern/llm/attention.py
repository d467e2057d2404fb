"""A small causal self-attention model over subword ids, in numpy.

One head over windows of ids. Ids are numbered by falling frequency. The next number is predicted in steps: which group of 32, if any of
the first 32 groups, then which one in the group; or, for the rarer rest, two digits in base 222. Biases are the smoothed distribution of
the training ids after the id before, so an untrained model already is that distribution and attention learns what it adds to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

GROUP = 32
COMMON = GROUP ** 2
REST = 222
VOCABULARY = COMMON + REST ** 2
SMALLEST = 1e-26  # sums of exponentials between this and its inverse are neither cut off nor lost
PRIOR = 20.0  # ids' worth of the distribution of all ids in that after one id
MIXED = 0.05  # share of the biases alone in a score, so that no training makes what it has not seen all but impossible
KNOWN = 1 << 12  # ids with an embedding of their own; rarer ones share


@dataclass(frozen=True)
class Shape:
    """``window`` ids of context at most; scoring takes ``step`` new ids per window, so at least ``window - step`` old ones are seen."""

    width: int = 16
    window: int = 32
    step: int = 24


@dataclass
class Model:
    shape: Shape
    rank: np.ndarray                # number of each id
    bias: list[np.ndarray]          # logits of the steps: (rows, 33), (rows * 32, 32), (222), (222, 222); a row for each id before, or one for all
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in sorted(self.weights)])

    def with_flat(self, values: np.ndarray) -> Model:
        out, at = {}, 0
        for k in sorted(self.weights):
            size = self.weights[k].size
            out[k] = values[at:at + size].reshape(self.weights[k].shape).astype(np.float32)
            at += size
        return Model(self.shape, self.rank, self.bias, out)


def initial(counts: dict[int, int], shape: Shape = Shape()) -> Model:
    """Numbers and biases from counts of ids; random small weights."""
    order = sorted(range(VOCABULARY), key=lambda i: (-counts.get(i, 0), i))
    rank = np.empty(VOCABULARY, np.int32)
    rank[order] = np.arange(VOCABULARY, dtype=np.int32)
    mass = np.array([counts.get(i, 0) for i in order], np.float64) + 0.01
    common, rest = mass[:COMMON].reshape(GROUP, GROUP), mass[COMMON:].reshape(REST, REST)
    first = np.append(common.sum(1), rest.sum())
    bias = [np.log(first / first.sum())[None], np.log(common / common.sum(1)[:, None]), np.log(rest.sum(1) / rest.sum()), np.log(rest / rest.sum(1)[:, None])]
    rng = np.random.default_rng(20012)
    d = shape.width
    small = lambda *s: rng.normal(0, 0.3 / d ** 0.5, s).astype(np.float32)
    weights = {"embed": rng.normal(0, 0.5, (KNOWN, d)).astype(np.float32), "place": small(shape.window, d), "q": small(d, d), "k": small(d, d), "v": small(d, d), "o": small(d, d),
               "u1": small(d, GROUP + 1), "u2": small(d, GROUP), "u3": small(d, REST), "u4": small(d, REST), "g2": np.ones((GROUP, d), np.float32)}
    return Model(shape, rank, [b.astype(np.float32) for b in bias], weights)


def pairs(numbers: np.ndarray) -> np.ndarray:
    """One key for each number and the one after it; the rarer ones share a key as the later one."""
    return (numbers[:-1] & (KNOWN - 1)).astype(np.int64) * (COMMON + 1) + np.minimum(numbers[1:], COMMON)


def after(model: Model, keys: np.ndarray, counts: np.ndarray) -> Model:
    """The model with biases for each number before, from counts by key of ``pairs``."""
    table = np.zeros(KNOWN * (COMMON + 1))
    table[keys] = counts
    table = table.reshape(KNOWN, COMMON + 1)
    first = np.exp(model.bias[0][0].astype(np.float64))
    table[:, :COMMON] += PRIOR * (first[:GROUP, None] * np.exp(model.bias[1])).ravel()
    table[:, COMMON] += PRIOR * first[GROUP]
    common = table[:, :COMMON].reshape(KNOWN, GROUP, GROUP)
    group = np.concatenate([common.sum(2), table[:, COMMON:]], 1)
    steps = np.log(group / group.sum(1)[:, None]), np.log(common / common.sum(2)[:, :, None]).reshape(-1, GROUP)
    return Model(model.shape, model.rank, [*[b.astype(np.float32) for b in steps], *model.bias[2:]], model.weights)


def _exponentials(logits: Callable[[], np.ndarray], seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the logits and their sums by row; 0 where ``seen`` is. Rows that leave the range of the numbers are made again with their
    largest logit at 0, which changes no probability. Cut off at a ceiling instead, the largest ones would become equal."""
    x = logits()
    np.exp(x, out=x)
    if seen is not None:
        x *= seen
    total = x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)
    if not (total.max(initial=1) < 1 / SMALLEST and total.min(initial=1) > SMALLEST):
        x = logits()
        if seen is not None:
            x += np.where(seen > 0, np.float32(0), np.float32(-1e9))
        x -= x.max(-1, keepdims=True)
        np.exp(x, out=x)
        total = x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)
    return x, total


@np.errstate(over="ignore", invalid="ignore")
def log_probabilities(model: Model, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log-probability of ``targets`` (numbers, the next id after each of the last positions of each window).

    A negative input is a position that does not exist and is not seen; a negative target gives 0.
    """
    w, (n, size), s = model.weights, inputs.shape, targets.shape[1]
    d = model.shape.width
    x = w["embed"].take(inputs & (KNOWN - 1), 0)
    x += w["place"]
    last = x[:, size - s:].reshape(-1, d)
    q = (last @ _met(model)).reshape(n, s, d)
    seen, none = _seen(size, s), np.flatnonzero(inputs.min(1, initial=0) < 0)
    if len(none):
        seen = np.repeat(seen[None], n, 0)
        seen[none] *= (inputs[none] >= 0)[:, None]
    share, total = _exponentials(lambda: q @ x.transpose(0, 2, 1), seen)
    y = (share @ x).reshape(-1, d)
    y /= total[:, None]
    h = y @ (w["v"] @ w["o"])
    h += last
    t = targets.ravel()
    real = np.flatnonzero(t >= 0)
    before = inputs[:, size - s:].ravel()
    if len(real) < len(t):
        t, h, before = t.take(real), h.take(real, 0), before.take(real)
    before = before & (len(model.bias[0]) - 1)
    group = np.minimum(t // GROUP, GROUP)
    inner = np.minimum(group, GROUP - 1)

    def head(name: str, own: np.ndarray, bias: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of what is picked, and its bias."""
        bias = np.broadcast_to(bias, (len(own), bias.shape[-1])) if bias.ndim == 1 else bias

        def logits() -> np.ndarray:
            x = own @ w[name]
            x += bias
            return x

        p, total = _exponentials(logits)
        spot = np.arange(0, p.size, p.shape[1]) + pick
        return p.ravel().take(spot) / total, bias.ravel().take(spot)

    out, plain = head("u1", h, model.bias[0].take(before, 0), group)
    gated = w["g2"].take(inner, 0)
    gated *= h
    rare = np.flatnonzero(t >= COMMON)
    own, left = h.take(rare, 0), t.take(rare) - COMMON
    high, low = left // REST, left % REST
    second, more = head("u2", gated, model.bias[1].take(before * GROUP + inner, 0), t % GROUP)
    third, its = head("u3", own, model.bias[2], high)
    fourth, bias = head("u4", own, model.bias[3].take(high, 0), low)
    second[rare], more[rare] = third * fourth, its + bias
    out *= second
    plain = plain + more
    # biases alone leave every id above exp(-60)
    out *= np.exp(-plain)
    out *= np.float32(1 - MIXED)
    out += np.float32(MIXED)
    whole = np.zeros(n * s, np.float32)
    whole[real] = np.log(out) + plain
    return whole.reshape(n, s)


def _met(model: Model) -> np.ndarray:
    """Queries by keys: what a position is multiplied by to meet the positions before it as they are."""
    w = model.weights
    return (w["q"] * np.float32(model.shape.width ** -0.5)) @ w["k"].T


MASKS: dict[tuple[int, int], np.ndarray] = {}


@np.errstate(over="ignore", invalid="ignore")
def gradient(model: Model, ids: np.ndarray, weight: np.ndarray, measured: bool = True) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss and gradients. ``ids``: numbers, one more than the inputs in each row; ``weight`` marks the targets that exist.

    Queries and keys are multiplied into one matrix first, and so are values and outputs: attention meets and mixes the positions as they are.
    Without ``measured`` the loss is left out, as 0. Both heads of common ids run over all rows,
    those of other ids with weight 0; the few rarer ids are taken out.
    """
    w, d = model.weights, model.shape.width
    inputs, t = ids[:, :-1], ids[:, 1:].ravel()
    n, size = inputs.shape
    e = inputs.ravel() & (KNOWN - 1)
    flat = w["embed"].take(e, 0)
    x = flat.reshape(n, size, d)
    x += w["place"][:size]
    met, into = _met(model), w["v"] @ w["o"]
    q = (flat @ met).reshape(n, size, d)
    share, total = _exponentials(lambda: q @ x.transpose(0, 2, 1), _seen(size, size))
    share /= total.reshape(n, size, 1)
    y = (share @ x).reshape(-1, d)
    h = y @ into
    h += flat
    scales = (weight.ravel() / max(weight.sum(), 1)).astype(np.float32)
    every = np.arange(len(t))
    before = inputs.ravel() & (len(model.bias[0]) - 1)
    group = np.minimum(t // GROUP, GROUP)
    inner = np.minimum(group, GROUP - 1)
    grads, loss = {}, 0.0

    def head(name: str, own: np.ndarray, bias: np.ndarray, pick: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Gradient of the logits' inputs; adds to the loss."""
        nonlocal loss

        def logits() -> np.ndarray:
            x = own @ w[name]
            x += bias
            return x

        p, total = _exponentials(logits)
        flat, spot = p.ravel(), every[:len(pick)] * p.shape[1] + pick
        if measured:
            loss -= float(np.log(flat.take(spot) / total + np.float32(1e-30)) @ marks)
        p *= (marks / total)[:, None]
        flat[spot] -= marks
        grads[name] = own.T @ p
        return p @ w[name].T

    dh = head("u1", h, model.bias[0].take(before, 0), group, scales)
    gate = w["g2"].take(inner, 0)
    back = head("u2", h * gate, model.bias[1].take(before * GROUP + inner, 0), t % GROUP, scales * (t < COMMON))
    member = np.zeros((len(t), GROUP), h.dtype)
    member.ravel()[every * GROUP + inner] = 1
    grads["g2"] = member.T @ (back * h)
    back *= gate
    dh += back
    rare = np.flatnonzero(t >= COMMON)
    own, left = h[rare], t[rare] - COMMON
    high, low = left // REST, left % REST
    dh[rare] += head("u3", own, model.bias[2], high, scales[rare]) + head("u4", own, model.bias[3][high], low, scales[rare])

    grads["v"], grads["o"] = (g := y.T @ dh) @ w["o"].T, w["v"].T @ g
    dy = dh @ into.T
    ds = dy.reshape(n, size, d) @ x.transpose(0, 2, 1)
    ds -= ((dy * y) @ np.ones(d, dy.dtype)).reshape(n, size, 1)  # what the mixture as a whole would lose
    ds *= share
    dq = (ds @ x).reshape(-1, d)
    g = (flat.T @ dq) * np.float32(d ** -0.5)
    grads["q"], grads["k"] = g @ w["k"], g.T @ w["q"]
    dh += dq @ met.T
    dx = dh.reshape(n, size, d)
    dx += share.transpose(0, 2, 1) @ dy.reshape(n, size, d)
    dx += ds.transpose(0, 2, 1) @ q
    grads["place"] = np.zeros_like(w["place"])
    grads["place"][:size] = dx.sum(0)
    grads["embed"] = _gather(e, dh, KNOWN)
    return loss, grads


def _seen(size: int, last: int) -> np.ndarray:
    """1 where one of the last positions (rows) sees a position."""
    if (size, last) not in MASKS:
        MASKS[size, last] = np.tri(last, size, size - last, dtype=np.float32)
    return MASKS[size, last]


def _gather(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits are sorted by counting
    ordered = rows.take(order)
    first = np.append(0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)
    out = np.zeros((size, values.shape[1]), values.dtype)
    out[ordered.take(first)] = np.add.reduceat(values.take(order, 0), first, 0)
    return out


class Adam:
    """Moves a model's weights in place: embeddings by row, all others as one vector of which they become views."""

    def __init__(self, model: Model, rate: float = 0.01) -> None:
        self.model, self.rate, self.turn = model, rate, 0
        self.names = [k for k in sorted(model.weights) if k != "embed"]
        self.rest = np.concatenate([model.weights[k].ravel() for k in self.names])
        at = 0
        for k in self.names:
            shape, size = model.weights[k].shape, model.weights[k].size
            model.weights[k] = self.rest[at:at + size].reshape(shape)
            at += size
        self.mean, self.square = np.zeros_like(self.rest), np.zeros_like(self.rest)
        self.rows = np.zeros_like(model.weights["embed"]), np.zeros_like(model.weights["embed"])

    def step(self, ids: np.ndarray, weight: np.ndarray, measured: bool = True) -> float:
        loss, grads = gradient(self.model, ids, weight, measured)
        self.turn += 1
        rate = self.rate * (1 - 0.99 ** self.turn) ** 0.5 / (1 - 0.9 ** self.turn)
        self.rest -= self._step(self.mean, self.square, np.concatenate([grads[k].ravel() for k in self.names]), rate)
        moved = np.zeros(KNOWN, bool)
        moved[ids[:, :-1] & (KNOWN - 1)] = True
        moved = np.flatnonzero(moved)  # only rows of this batch move
        m, s = (x.take(moved, 0) for x in self.rows)
        self.model.weights["embed"][moved] -= self._step(m, s, grads["embed"].take(moved, 0), rate)
        self.rows[0][moved], self.rows[1][moved] = m, s
        return loss

    @staticmethod
    def _step(m: np.ndarray, s: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        """How far to go; ``m`` and ``s`` are brought up to date."""
        m *= 0.9
        m += 0.1 * g
        step = g * g
        step *= 0.01
        s *= 0.99
        s += step
        np.sqrt(s, out=step)
        step += 1e-8
        np.divide(m, step, out=step)
        step *= np.float32(rate)
        return step
