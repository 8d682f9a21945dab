"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Documents run in lanes, one after the other, so a step is one product for all lanes; the state is
carried from window to window and cleared where a document starts. A token is a head word, which has
a class and a place in it, or stands for the rare words of a class. The output is a softmax over classes
and, for head words, one over the members of the class; both see the state.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
LANES = 256
WINDOW = 16
SCORE_LANES = 1024
SCORE_WINDOW = 16
RATE = 0.006


@dataclass(frozen=True)
class Shape:
    """Token numbers: head word i below heads (class i // members), then one per rare class, then the start."""

    heads: int
    members: int
    rare: int

    @property
    def head_classes(self) -> int:
        return -(-self.heads // self.members)

    @property
    def classes(self) -> int:
        return self.head_classes + self.rare

    @property
    def start(self) -> int:
        return self.heads + self.rare


def initial(shape: Shape, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights; biases are log frequencies, so the model starts as a unigram one. counts: by token number."""
    rng = np.random.default_rng(seed)
    by_class = np.add.reduceat(counts[: shape.heads], np.arange(0, shape.heads, shape.members)) if shape.heads else np.zeros(0)
    of_class = np.concatenate([by_class, counts[shape.heads :]]) + 1.0
    within = np.full((shape.head_classes, shape.members), -30.0)
    within.ravel()[: shape.heads] = np.log(counts[: shape.heads] + 1.0)
    draw = lambda *size: rng.normal(0, 0.1, size)
    p = {
        "wx": draw(shape.start + 1, 3 * hidden), "u": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden),
        "wo": draw(hidden, shape.classes) * 0.1, "bo": np.log(of_class / of_class.sum()),
        "wi": draw(shape.head_classes, hidden, shape.members) * 0.1, "bi": within,
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def lanes(documents: list[np.ndarray], most: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers and document indexes by step and lane, -1 where a lane has ended."""
    lengths = np.array([len(d) for d in documents])
    n = int(max(1, min(most, lengths.sum() // max(1, lengths.max()))))
    ends = [(0, k) for k in range(n)]
    where: list[list[int]] = [[] for _ in range(n)]
    for i in np.argsort(-lengths, kind="stable"):
        end, k = heapq.heappop(ends)
        where[k].append(int(i))
        heapq.heappush(ends, (end + int(lengths[i]), k))
    steps = max(e for e, _ in ends)
    tokens, owner = np.full((steps, n), -1, np.int32), np.full((steps, n), -1, np.int32)
    for k, own in enumerate(where):
        if own:
            row = np.concatenate([documents[i] for i in own])
            tokens[: len(row), k] = row
            owner[: len(row), k] = np.repeat(own, lengths[own])
    return tokens, owner


def _inputs(tokens: np.ndarray, owner: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The token before each one in its document, and whether it is the first."""
    first = np.ones(owner.shape, bool)
    first[1:] = owner[1:] != owner[:-1]
    before = np.full(tokens.shape, shape.start, np.int32)
    before[1:][~first[1:]] = tokens[:-1][~first[1:]]
    before[before < 0] = shape.start
    return before, first


def _run(p: dict, before: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool):
    """States after each step from h on, by step, unit and lane; with ``keep`` what backpropagation needs.

    Lanes come last everywhere, so a gate's units are whole runs of memory. h: by unit and lane.
    """
    n, (steps, lanes) = len(h), before.shape
    # A gate is (1 + tanh(x / 2)) / 2, so the gates' columns are halved once.
    half = np.repeat(np.array([0.5, 1], p["u"].dtype), [2 * n, n])
    u = np.ascontiguousarray((p["u"] * half).T)
    inputs = np.ascontiguousarray(((p["wx"] + p["b"]) * half)[before].transpose(0, 2, 1))
    states = np.empty((steps, n, lanes), inputs.dtype)
    kept = [np.empty((steps, k * n, lanes), inputs.dtype) for k in (1, 2, 1, 1)] if keep else []
    one_half, starts = inputs.dtype.type(0.5), first.any(1)
    for t in range(steps):
        if starts[t]:
            h = np.where(first[t], inputs.dtype.type(0), h)
        both = u @ h
        gates, inner = both[: 2 * n], both[2 * n :]
        gates += inputs[t, : 2 * n]
        np.tanh(gates, out=gates)
        gates *= one_half
        gates += one_half
        if keep:
            for into, what in zip(kept, (h, gates, inner), strict=False):
                into[t] = what
        new = gates[n:] * inner
        new += inputs[t, 2 * n :]
        np.tanh(new, out=new)
        if keep:
            kept[3][t] = new
        h = np.subtract(h, new, out=states[t])
        h *= gates[:n]
        h += new
    return states, kept


def _by_unit(x: np.ndarray) -> np.ndarray:
    """From (step, unit, lane) to (unit, step and lane)."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax down the columns, in place, and the logarithm of what each was divided by."""
    top = logits.max(0)
    logits -= top
    np.exp(logits, out=logits)
    total = logits.sum(0)
    logits /= total
    return logits, np.log(total) + top


def _log_total(logits: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of each column; changes logits."""
    top = logits.max(0)
    logits -= top
    return np.log(np.exp(logits, out=logits).sum(0)) + top


def _classes(tokens: np.ndarray, shape: Shape) -> np.ndarray:
    return np.where(tokens < shape.heads, tokens // shape.members, tokens - shape.heads + shape.head_classes)


def _groups(classes: np.ndarray, shape: Shape) -> Iterator[tuple[int, slice]]:
    """Head classes that occur, with where their tokens lie; classes is sorted."""
    edges = np.searchsorted(classes, np.arange(shape.head_classes + 1))
    for c in range(shape.head_classes):
        if edges[c + 1] > edges[c]:
            yield c, slice(edges[c], edges[c + 1])


def _member_logits(p: dict, x: np.ndarray, classes: np.ndarray, groups: list[tuple[int, slice]]) -> np.ndarray:
    """Logits of the members of each head token's class, by member and token: one product a class, the rest at once."""
    n = groups[-1][1].stop if groups else 0
    logits = np.empty((p["bi"].shape[1], n), x.dtype)
    for c, own in groups:
        logits[:, own] = p["wi"][c].T @ x[:, own]
    logits += p["bi"].T.take(classes[:n], 1)
    return logits


def _by_class(states: np.ndarray, tokens: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Positions of the tokens in order of their classes, and by that order states (by unit), tokens and classes."""
    at = np.flatnonzero(tokens.ravel() >= 0)
    y = tokens.ravel()[at]
    classes = _classes(y, shape)
    # Small numbers are sorted by radix.
    order = np.argsort(classes.astype(np.int16) if shape.classes < 1 << 15 else classes, kind="stable")
    return at[order], _by_unit(states).take(at[order], 1), y[order], classes[order]


def log_probabilities(p: dict, shape: Shape, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole document's token numbers; the state runs through all of it."""
    tokens, owner = lanes(documents, SCORE_LANES)
    before, first = _inputs(tokens, owner, shape)
    out = np.zeros(tokens.shape, np.float32)
    h = np.zeros((len(p["u"]), tokens.shape[1]), p["u"].dtype)
    for t in range(0, len(tokens), SCORE_WINDOW):
        states, _ = _run(p, before[t : t + SCORE_WINDOW], first[t : t + SCORE_WINDOW], h, False)
        h = states[-1]
        at, x, y, classes = _by_class(states, tokens[t : t + SCORE_WINDOW], shape)
        logits = p["wo"].T @ x + p["bo"][:, None]
        found = logits[classes, np.arange(len(y))]
        found -= _log_total(logits)
        inner = _member_logits(p, x, classes, list(_groups(classes, shape)))
        n = inner.shape[1]
        found[:n] += inner[y[:n] - classes[:n] * shape.members, np.arange(n)]
        found[:n] -= _log_total(inner)
        out[t : t + SCORE_WINDOW].ravel()[at] = found
    there = owner >= 0
    return np.bincount(owner[there], out[there].astype(float), minlength=len(documents))


def gradients(p: dict, shape: Shape, tokens: np.ndarray, before: np.ndarray, first: np.ndarray, h: np.ndarray):
    """Loss (nats), number of tokens, gradients of the mean loss, and the last state, over one window. h: by lane and unit."""
    n = h.shape[1]
    states, kept = _run(p, before, first, np.ascontiguousarray(h.T), True)
    at, x, y, classes = _by_class(states, tokens, shape)
    size = max(1, len(y))
    g = {k: np.zeros_like(v) for k, v in p.items()}
    rows = np.arange(len(y))
    logits = p["wo"].T @ x + p["bo"][:, None]
    own_logit = logits[classes, rows]
    prob, log_total = _softmax(logits)
    loss = float((log_total - own_logit).sum())
    prob[classes, rows] -= 1
    prob *= 1 / size
    g["wo"], g["bo"] = x @ prob.T, prob.sum(1)
    dx = p["wo"] @ prob
    groups = list(_groups(classes, shape))
    logits = _member_logits(p, x, classes, groups)
    heads = logits.shape[1]
    place = y[:heads] - classes[:heads] * shape.members, rows[:heads]
    own_logit = logits[place]
    inner, log_total = _softmax(logits)
    loss += float((log_total - own_logit).sum())
    inner[place] -= 1
    inner *= 1 / size
    for c, part in groups:
        own = inner[:, part]
        g["wi"][c], g["bi"][c] = x[:, part] @ own.T, own.sum(1)
        dx[:, part] += p["wi"][c] @ own
    in_order, dx = dx, np.zeros((n, tokens.size), dx.dtype)
    dx[:, at] = in_order
    dstates = dx.reshape(n, *tokens.shape).transpose(1, 0, 2)
    # What doesn't depend on the gradient of the state is worked out for all steps at once.
    was, gates, gh, new = kept
    z, r = gates[:, :n], gates[:, n:]
    to_new, to_z, to_r = (1 - z) * (1 - new * new), (was - new) * z * (1 - z), gh * r * (1 - r)
    dgates, through = (np.empty((len(tokens), 3 * n, tokens.shape[1]), states.dtype) for _ in range(2))
    dh, starts = np.zeros_like(states[0]), first.any(1)
    for t in range(len(tokens) - 1, -1, -1):
        dh += dstates[t]
        own, dnew = through[t], dgates[t, 2 * n :]
        np.multiply(dh, to_new[t], out=dnew)
        np.multiply(dh, to_z[t], out=own[:n])
        np.multiply(dnew, to_r[t], out=own[n : 2 * n])
        np.multiply(dnew, r[t], out=own[2 * n :])
        dh *= z[t]
        dh += p["u"] @ own
        if starts[t]:
            dh = np.where(first[t], states.dtype.type(0), dh)
    dgates[:, : 2 * n] = through[:, : 2 * n]
    g["u"] = _by_unit(was) @ _by_unit(through).T
    # Sums by input: in order of the inputs they are runs.
    by_unit, inputs = _by_unit(dgates), before.ravel()
    g["b"] = by_unit.sum(1)
    order = np.argsort(inputs.astype(np.int16) if shape.start < 1 << 15 else inputs, kind="stable")
    inputs = inputs[order]
    runs = np.flatnonzero(np.diff(inputs, prepend=-1))
    g["wx"][inputs[runs]] = np.add.reduceat(by_unit.take(order, 1), runs, axis=1).T
    return loss, len(y), g, states[-1].T


class Trainer:
    """Adam over windows of a stream of documents."""

    def __init__(self, p: dict, shape: Shape, rate: float = RATE):
        self.shape, self.rate = shape, rate
        # All weights lie in one array, of which p has views, so a step is a few operations on the whole.
        self.flat = np.concatenate([v.ravel() for v in p.values()])
        ends = np.cumsum([v.size for v in p.values()])
        self.p = {k: self.flat[end - v.size : end].reshape(v.shape) for (k, v), end in zip(p.items(), ends, strict=True)}
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.steps = self.tokens = 0

    def fit(self, documents: list[np.ndarray]) -> float:
        """One pass; the mean loss a token, in nats."""
        tokens, owner = lanes(documents)
        before, first = _inputs(tokens, owner, self.shape)
        h = np.zeros((tokens.shape[1], len(self.p["u"])), np.float32)
        total = seen = 0
        for t in range(0, len(tokens), WINDOW):
            w = slice(t, t + WINDOW)
            loss, n, g, h = gradients(self.p, self.shape, tokens[w], before[w], first[w], h)
            self.steps += 1
            # A Python number, so that arrays stay in single precision.
            scale = self.rate * (n / (n + 256)) * (1 - 0.999**self.steps) ** 0.5 / (1 - 0.9**self.steps)
            m, v, d = self.m, self.v, np.concatenate([g[k].ravel() for k in self.p])
            np.clip(d, -1, 1, out=d)
            m *= 0.9
            m += 0.1 * d
            v *= 0.999
            d *= d
            d *= 0.001
            v += d
            root = np.sqrt(v, out=d)
            root += 1e-8
            np.divide(m, root, out=root)
            root *= scale
            self.flat -= root
            total, seen = total + loss, seen + n
        self.tokens += seen
        return total / max(1, seen)
