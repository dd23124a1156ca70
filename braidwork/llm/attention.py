"""A small causal self-attention language model in numpy: one layer over classes of subword ids.

A subword's probability is that of its class under the model times its share of the class. Frequent subwords are
classes of their own. A class is predicted in two steps, its group and then its place in the group, each by a softmax;
class c is number c // GROUPS in group c % GROUPS. Subwords that begin a word are in the first START groups, so that
the probability of a word's end is known at every step. Windows of LENGTH ids overlap, so that every id but a text's first ones has context, and each id is
scored once; all windows of a batch go through masked attention together.
"""

from __future__ import annotations

import numpy as np

LENGTH, STRIDE = 32, 24
GROUPS, START = 16, 8
DIM, HIDDEN = 24, 48
_EPS = 1e-5
#: Windows of a training step, and those that go through attention at once: what is worked on should stay in a core's cache.
BATCH, AT_ONCE = 128, 32


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    return {
        "tok": (classes, DIM), "pos": (LENGTH, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM),
        "up": (DIM, HIDDEN), "down": (HIDDEN, DIM), "group": (DIM, GROUPS), "gbias": (GROUPS,),
        "out": (GROUPS, DIM, -(-classes // GROUPS)), "bias": (GROUPS, -(-classes // GROUPS)),
    }


def fresh(frequency: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """A model that starts at the classes' frequencies."""
    r = np.random.default_rng(seed)
    p = {n: r.normal(0, 0.3 if n in ("tok", "pos") else 0.1 if n in ("group", "out") else s[0] ** -0.5, s).astype(np.float32) for n, s in shapes(len(frequency)).items()}
    share = np.zeros(p["bias"].size)
    share[: len(frequency)] = frequency + 0.5
    share = share.reshape(-1, GROUPS).T  # a place no class has gets next to nothing
    p["gbias"] = np.log(np.maximum(share.sum(1), 1e-6)).astype(np.float32)
    p["gbias"] -= p["gbias"].max()
    p["bias"] = np.log(np.maximum(share / np.maximum(share.sum(1, keepdims=True), 1e-6), 1e-9)).astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def unflat(x: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, s in shapes(classes).items():
        size = int(np.prod(s))
        out[n], at = x[at : at + size].reshape(s).astype(np.float32), at + size
    return out


def _norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = (1 / np.sqrt(np.einsum("...i,...i->...", x, x) / x.shape[-1] + _EPS))[..., None]
    return x * r, r


def _norm_back(g: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = y * (np.einsum("...i,...i->...", g, y) / -g.shape[-1])[..., None]
    out += g
    out *= r
    return out


_MASK = np.where(np.tril(np.ones((LENGTH, LENGTH), bool)), 0, -1e9).astype(np.float32)


def _exponential(x: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(x - top) in place, its totals over the last axis, and top.

    top is the largest value, or zero where the bound of x leaves room, so that none has to be looked for."""
    top = np.zeros(x.shape[:-1], x.dtype)
    if bound >= 80:
        top = x.max(-1)
        x -= top[..., None]
    np.exp(x, out=x)
    total = (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(x.shape[:-1])  # faster than a sum over a short axis
    return x, total, top


def _joined(p: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
    """What gives queries (scaled), keys and values in one product, and a bound of attention's logits."""
    scale = p["q"].dtype.type(DIM**-0.5)
    return np.concatenate([p["q"] * scale, p["k"], p["v"]], axis=1), DIM**0.5 * float(np.linalg.norm(p["q"] @ p["k"].T))


def _attended(p: dict[str, np.ndarray], qkv: np.ndarray, bound: float, tok: np.ndarray) -> tuple:
    """Of windows tok (batch, LENGTH): embedded, normalised, with scales, queries and so on; unnormalised attention, its totals."""
    x = p["tok"].take(tok.ravel(), axis=0)
    x.reshape(-1, LENGTH * DIM)[:] += p["pos"].ravel()
    h, hr = _norm(x)
    w = (h @ qkv).reshape(-1, LENGTH, 3 * DIM)
    a = w[..., :DIM] @ w[..., DIM : 2 * DIM].transpose(0, 2, 1)  # large arrays are worked on in place: fresh memory costs more than the arithmetic
    a += _MASK
    a, total, _ = _exponential(a, bound)
    return x, h, hr, w, a, total


def _rest(p: dict[str, np.ndarray], x: np.ndarray, c: np.ndarray) -> tuple:
    """From what attention gathers to normalised last states, at any positions."""
    y = c @ p["o"]
    y += x
    g, gr = _norm(y)
    u = g @ p["up"]
    np.maximum(u, 0, out=u)
    z = u @ p["down"]
    z += y
    f, fr = _norm(z)
    return f, fr, g, gr, u


def _by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their target's group, and where each group begins."""
    group = (target % GROUPS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))])


def _bounds(p: dict[str, np.ndarray]) -> tuple[float, float]:
    """Bounds of the logits of groups, and of places in them, of normalised states."""
    return tuple(float(DIM**0.5 * np.sqrt((p[n] ** 2).sum(-2).max()) + np.abs(p[b]).max()) for n, b in (("group", "gbias"), ("out", "bias")))


def _choices(p: dict[str, np.ndarray], f: np.ndarray, target: np.ndarray, begin: np.ndarray) -> tuple:
    """Of states f in the order of their targets' groups: the targets' log probabilities; exponentials and totals by groups, and by places."""
    group_bound, place_bound = _bounds(p)
    row = np.arange(len(f))
    of_group = f @ p["group"]
    of_group += p["gbias"]
    value = of_group[row, target % GROUPS]
    of_group, group_total, top = _exponential(of_group, group_bound)
    value -= np.log(group_total) + top
    of_place = np.empty((len(f), p["out"].shape[2]), f.dtype)
    for j in range(GROUPS):
        own = slice(begin[j], begin[j + 1])
        np.matmul(f[own], p["out"][j], out=of_place[own])
        of_place[own] += p["bias"][j]
    value += of_place[row, target // GROUPS]
    of_place, place_total, top = _exponential(of_place, place_bound)
    value -= np.log(place_total) + top
    return value, of_group, group_total, of_place, place_total


def log_likelihood(p: dict[str, np.ndarray], tok: np.ndarray, target: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs, where scored (in the order of tok[scored]): of the targets' class probabilities, and of the
    probability that the target begins a word."""
    qkv, bound = _joined(p)
    f = []
    for i in range(0, len(tok), AT_ONCE):
        x, _, _, w, a, total = _attended(p, qkv, bound, tok[i : i + AT_ONCE])
        at = np.flatnonzero(scored[i : i + AT_ONCE])  # what follows attention is needed there only
        c = (a @ w[..., 2 * DIM :]).reshape(-1, DIM).take(at, axis=0)
        c *= (1 / total).reshape(-1, 1)[at]
        f.append(_rest(p, x.take(at, axis=0), c)[0])
    target = target[scored]
    order, begin = _by_group(target)
    value, of_group, total, _, _ = _choices(p, np.concatenate([np.empty((0, DIM), p["tok"].dtype), *f]).take(order, axis=0), target[order], begin)
    starts = np.log(of_group[:, :START] @ np.ones(START, of_group.dtype)) - np.log(total)
    out, begins = np.empty_like(value), np.empty_like(starts)
    out[order], begins[order] = value, starts
    return out, begins


def gradient(p: dict[str, np.ndarray], tok: np.ndarray, target: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over live targets and its gradient. Windows go through attention AT_ONCE, and come back so."""
    qkv, bound = _joined(p)
    kept, f = [], np.empty((tok.size, DIM), p["tok"].dtype)
    cuts = [slice(i * LENGTH, min(i + AT_ONCE, len(tok)) * LENGTH) for i in range(0, len(tok), AT_ONCE)]
    for own in cuts:
        x, h, hr, w, a, total = _attended(p, qkv, bound, tok[own.start // LENGTH : own.stop // LENGTH])
        a *= (1 / total)[..., None]
        c = (a @ w[..., 2 * DIM :]).reshape(-1, DIM)
        f[own], fr, g, gr, u = _rest(p, x, c)
        kept.append((h, hr, w, a, c, g, gr, u, fr))
    at = np.flatnonzero(live)
    order, begin = _by_group(target.ravel()[at])
    at = at[order]
    t, near = target.ravel()[at], f.take(at, axis=0)
    n, row = max(len(t), 1), np.arange(len(t))
    value, e, total, places, place_total = _choices(p, near, t, begin)
    e *= (1 / total)[:, None]
    e[row, t % GROUPS] -= 1
    places *= (1 / place_total)[:, None]
    places[row, t // GROUPS] -= 1
    d = {"group": near.T @ e / n, "gbias": e.sum(0) / n, "out": np.empty_like(p["out"]), "bias": np.empty_like(p["bias"])}
    back, by_place = e @ p["group"].T, np.empty_like(near)
    for j in range(GROUPS):
        own = slice(begin[j], begin[j + 1])
        np.matmul(near[own].T, places[own], out=d["out"][j])
        d["bias"][j] = places[own].sum(0)
        np.matmul(places[own], p["out"][j].T, out=by_place[own])
    d["out"] /= n
    d["bias"] /= n
    back += by_place
    back /= n
    df, dx = np.zeros_like(f), np.empty_like(f)
    df[at] = back
    d |= {k: np.zeros_like(p[k]) for k in ("o", "up", "down")}
    dqkv = np.zeros_like(qkv)
    for own, (h, hr, w, a, c, g, gr, u, fr) in zip(cuts, kept):
        dz = _norm_back(df[own], f[own], fr)
        d["down"] += u.T @ dz
        du = dz @ p["down"].T
        du *= u > 0
        d["up"] += g.T @ du
        dy = _norm_back(du @ p["up"].T, g, gr)
        dy += dz
        d["o"] += c.T @ dy
        dc = dy @ p["o"].T
        weight = np.einsum("ij,ij->i", dc, c).reshape(-1, LENGTH, 1)  # what its own weights add to a place's gradient
        dc = dc.reshape(-1, LENGTH, DIM)
        da = dc @ w[..., 2 * DIM :].transpose(0, 2, 1)
        da -= weight
        da *= a
        np.matmul(a.transpose(0, 2, 1), dc, out=w[..., 2 * DIM :])  # what has been used gives room to its gradient
        dq = da @ w[..., DIM : 2 * DIM]
        np.matmul(da.transpose(0, 2, 1), w[..., :DIM], out=w[..., DIM : 2 * DIM])  # queries are scaled already
        w[..., :DIM] = dq
        dw = w.reshape(-1, 3 * DIM)
        dqkv += h.T @ dw
        dx[own] = _norm_back(dw @ qkv.T, h, hr)
        dx[own] += dy
    d["q"], d["k"], d["v"] = dqkv[:, :DIM] * qkv.dtype.type(DIM**-0.5), dqkv[:, DIM : 2 * DIM], dqkv[:, 2 * DIM :]
    d["tok"] = np.zeros_like(p["tok"])
    order = np.argsort(tok.ravel().astype(np.uint16), kind="stable")
    own = tok.ravel()[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    d["tok"][own[first]] = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
    d["pos"] = dx.reshape(-1, LENGTH, DIM).sum(0)
    return -float(value.sum()) / n, d


def windows(ids: np.ndarray, at: np.ndarray, start: int, turns: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input, target, scored), each (windows, LENGTH): the sequences ids[at[i]:at[i+1]], every id a target once.

    The input is shifted by one; `start` stands before a sequence's first id. The first window scores all its targets,
    each further one its last STRIDE. With turns, one in so many of each sequence's windows is taken, one at least, from
    a place that its length decides.
    """
    size = np.diff(at)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - LENGTH) // STRIDE)), 0)
    begin = size % np.maximum(np.minimum(turns, count), 1)
    taken = np.where(count > 0, -(-(count - begin) // turns), 0)
    seq = np.repeat(np.arange(len(size)), taken)
    number = begin[seq] + turns * (np.arange(len(seq)) - np.repeat(np.cumsum(taken) - taken, taken))
    step = np.arange(LENGTH)
    place = number[:, None] * STRIDE + step  # of the target, within its sequence
    inside = place < size[seq][:, None]
    where = np.minimum(at[seq][:, None] + place, max(len(ids) - 1, 0))
    target = np.where(inside, ids[where], 0)
    before = np.where(place > 0, ids[np.maximum(where - 1, 0)], start)
    scored = inside & ((number[:, None] == 0) | (step >= LENGTH - STRIDE))
    return np.where(inside, before, start), target, scored


def fit(p: dict[str, np.ndarray], tok: np.ndarray, target: np.ndarray, live: np.ndarray, steps: int, rate: float, batch: int = BATCH, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on batches of windows, with a rate that falls to a tenth. Windows are taken in a random order, all of them
    once before any comes again."""
    if not len(tok):
        return p
    batch = min(batch, len(tok))
    r = np.random.default_rng(seed)
    x, at = np.concatenate([v.ravel() for v in p.values()]), np.cumsum([0, *(v.size for v in p.values())])
    p = {n: x[a:b].reshape(v.shape) for (n, v), a, b in zip(p.items(), at, at[1:])}  # views of x
    m, s = np.zeros_like(x), np.zeros_like(x)
    order = np.empty(0, dtype=np.int64)
    for t in range(1, steps + 1):
        if not len(order):
            order = r.permutation(len(tok))
        i, order = order[:batch], order[batch:]
        _, d = gradient(p, tok[i], target[i], live[i])
        g = np.concatenate([d[n].ravel() for n in p])
        lr = rate * (1 - 0.9 * t / steps)
        m += 0.1 * (g - m)
        g *= g
        s += 0.02 * (g - s)
        x -= (lr / (1 - 0.9**t)) * m / (np.sqrt(s / (1 - 0.98**t)) + x.dtype.type(1e-8))
    return p
