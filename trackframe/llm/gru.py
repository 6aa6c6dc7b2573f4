"""The numbers of the gated recurrent language model: a step, whole sequences, and truncated backpropagation over windows.

Tokens are numbers: head words below ``classes * per_class`` (class = number // per_class), then one number for all
other words, which form the last class.  The output is factored: a softmax over the classes, then one within the class.
"""

from __future__ import annotations

import numpy as np

WINDOW = 32
CHUNK = 2048  # states whose outputs are worked out at a time
TOGETHER = 1024  # sequences that run in step
STATES = 8192
BLOCK = 16_384  # weights updated at a time


def fresh(mass: np.ndarray, rare: float, hidden: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights whose output is the unigram distribution: mass [classes, per_class] of the head words, rare of the rest."""
    k, m = mass.shape
    rng = np.random.default_rng(seed)
    f = np.float32
    total = np.append(mass.sum(axis=1), rare)
    with np.errstate(divide="ignore"):
        word, group = np.log(np.maximum(mass, 1e-30)), np.log(np.maximum(total, 1e-6))
    return {"x": (0.1 * rng.standard_normal((k * m + 1, 3 * hidden))).astype(f), "u": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "cw": np.zeros((hidden, k + 1), f), "cb": group.astype(f), "ow": np.zeros((k, hidden, m), f), "ob": word.astype(f)}


def folded(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """The weights of inputs and states such that z and r are 1 / (1 + exp(.)) and n is 1 - 2 / (1 + exp(.))."""
    by = np.repeat([-1, -1, 2], len(w["u"])).astype(w["u"].dtype)
    return w["x"] * by, w["u"] * by


def cell(u: np.ndarray, g: np.ndarray, h: np.ndarray, a: np.ndarray, new: np.ndarray) -> None:
    """One step of states as columns, in place: ``g`` [3 hidden, n] holds the folded part of the inputs, then z, r and n;
    ``a`` gets that of the states and ``new`` the next states."""
    d = len(h)
    np.matmul(u.T, h, out=a)
    zr, n = g[:2 * d], g[2 * d:]
    zr += a[:2 * d]
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    n += np.multiply(zr[d:], a[2 * d:], out=new)
    np.exp(n, out=n)
    n += 1
    np.divide(-2, n, out=n)
    n += 1
    np.subtract(h, n, out=new)
    new *= zr[:d]
    new += n


def step(w: dict, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states [n, hidden] after the tokens ids, a view of columns, and the gates as columns."""
    x, u = w["folded"] if "folded" in w else folded(w)
    h, g = np.ascontiguousarray(h.T), np.ascontiguousarray(x.take(ids, axis=0).T)
    new = np.empty_like(h)
    with np.errstate(over="ignore"):  # a closed gate
        cell(u, g, h, np.empty_like(g), new)
    return new.T, g


def softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(x - its column's largest) in place: the column sums, and the log of the softmax in row ``at`` of each column."""
    x -= x.max(axis=0)
    goal = x[at, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return total, goal - np.log(total)


def with_ones(h: np.ndarray) -> np.ndarray:
    """States [..., hidden] as rows [n, hidden + 1] that end in a one, whose weights are the biases."""
    out = np.empty((*h.shape[:-1], h.shape[-1] + 1), h.dtype)
    out[..., :-1], out[..., -1] = h, 1
    return out.reshape(-1, out.shape[-1])


def with_biases(w: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.vstack([w["cw"], w["cb"]]), np.concatenate([w["ow"], w["ob"][:, None]], axis=1)


def by_class(goal: np.ndarray, k: int, m: int) -> tuple[np.ndarray, list[tuple[int, slice]], np.ndarray]:
    """Places of the head words by class, the slices of the classes met, and every place's class."""
    group = (goal // m).astype(np.uint8 if k < 256 else np.int64)  # few classes: a radix sort
    cut = np.append(0, np.cumsum(np.bincount(group, minlength=k + 1)))
    return np.argsort(group, kind="stable")[:cut[k]], [(c, slice(cut[c], cut[c + 1])) for c in range(k) if cut[c + 1] > cut[c]], group


def output(w: dict, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log of P(class) and, for head words, of P(word within the class), for states h and next tokens ids."""
    k, m = w["ob"].shape
    cw, ow = with_biases(w)
    order, met, group = by_class(ids, k, m)
    rows, out = with_ones(h), np.empty(len(ids), h.dtype)
    for i in range(0, len(ids), CHUNK):
        out[i:i + CHUNK] = softmax(cw.T @ rows[i:i + CHUNK].T, group[i:i + CHUNK])[1]
    own, word, logs = rows.take(order, axis=0), ids[order] % m, np.empty(len(order), h.dtype)
    for c, at in met:
        for i in range(at.start, at.stop, CHUNK):
            to = slice(i, min(i + CHUNK, at.stop))
            logs[to] = softmax(ow[c].T @ own[to].T, word[to])[1]
    out[order] += logs
    return out


def document_logs(w: dict, docs: list[np.ndarray], start: int) -> np.ndarray:
    """Natural log-likelihood of each token sequence.  ``TOGETHER`` sequences of near lengths run in step from a zero state
    and the ``start`` token, and the longest run on when the others have ended; outputs follow for ``STATES`` states at a time."""
    w = w | {"folded": folded(w)}
    size = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-size, kind="stable")
    out = np.zeros(len(docs))
    for i in range(0, len(docs), TOGETHER):
        some = order[i:i + TOGETHER]
        out[some] = in_step(w, [docs[k] for k in some], size[some], start)
    return out


def in_step(w: dict, docs: list[np.ndarray], left: np.ndarray, start: int) -> np.ndarray:
    """The log-likelihoods of sequences of falling lengths ``left``."""
    total, flat, begin = np.zeros(len(docs)), np.concatenate(docs), np.cumsum(left) - left
    alive = len(left) - np.cumsum(np.bincount(left, minlength=1))  # sequences longer than s
    h, last = np.zeros((len(docs), w["u"].shape[0]), np.float32), np.full(len(docs), start)
    states, targets, owner, held = [], [], [], 0
    for s in range(int(left[0])):
        n = alive[s]
        if n < len(h):
            h, last = h[:n], last[:n]
        h, _ = step(w, h, last)
        last = flat[begin[:n] + s]
        states.append(h)
        targets.append(last)
        owner.append(np.arange(n))
        held += n
        if held >= STATES or s + 1 == left[0]:
            logs = output(w, np.concatenate(states), np.concatenate(targets))
            total += np.bincount(np.concatenate(owner), logs, minlength=len(docs))
            states, targets, owner, held = [], [], [], 0
    return total


def gradient(w: dict, h: np.ndarray, ids: np.ndarray, targets: np.ndarray, begins: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Loss gradient over one window [steps, streams], the state after it, and the mean loss; a text begins at zero.

    The recurrence holds states as columns, so that each operation runs over whole gates, which live in one array that
    the step fills in place.  The output holds states as rows and logits as columns; words of one class, and inputs of
    one word, meet by a sort.
    """
    steps, streams = ids.shape
    d, (k, m), kind = h.shape[1], w["ob"].shape, w["u"].dtype
    going = (~begins).astype(kind)
    words = ids.ravel()
    x, u = folded(w)
    gates = np.ascontiguousarray(x.take(words, axis=0).reshape(steps, streams, 3 * d).transpose(0, 2, 1))  # then z, r and n
    held = np.empty_like(gates)
    before, flat = (np.empty((steps, d, streams), kind) for _ in range(2))
    h = h.T
    with np.errstate(over="ignore"):  # a closed gate
        for t in range(steps):
            np.multiply(h, going[t], out=before[t])
            h = flat[t]
            cell(u, gates[t], before[t], held[t], h)
    n, goal = steps * streams, targets.ravel()
    rows, place, (cw, ow) = with_ones(flat.transpose(0, 2, 1)), np.arange(n), with_biases(w)
    order, met, group = by_class(goal, k, m)
    dc = cw.T @ rows.T
    total, logs = softmax(dc, group)
    loss = -logs.sum()
    dc *= 1 / (total * n)
    dc[group, place] -= 1 / n
    by, dh = dc @ rows, dc.T @ w["cw"].T
    grad = {"cw": by[:, :d].T, "cb": by[:, d], "ow": np.zeros_like(w["ow"]), "ob": np.zeros_like(w["ob"])}
    if met:
        own, word = rows.take(order, axis=0), goal[order] % m
        do, back = np.empty((m, len(order)), kind), np.empty((len(order), d), kind)
        for c, at in met:
            np.matmul(ow[c].T, own[at].T, out=do[:, at])
        total, logs = softmax(do, word)
        loss -= logs.sum()
        do *= 1 / (total * n)
        do[word, place[:len(order)]] -= 1 / n
        for c, at in met:
            by = do[:, at] @ own[at]
            grad["ow"][c], grad["ob"][c] = by[:, :d].T, by[:, d]
            np.matmul(do[:, at].T, w["ow"][c].T, out=back[at])
        dh[order] += back
    dh = np.ascontiguousarray(dh.reshape(steps, streams, d).transpose(0, 2, 1))
    z, r, new = gates[:, :d], gates[:, d:2 * d], gates[:, 2 * d:]
    # what the gates' derivatives hold besides the incoming gradient: of z, of r, and of the state's part of n (folded twice)
    to_n, to = (1 - z) * (1 - new * new), np.empty((steps, 3, d, streams), kind)
    np.multiply((before - new) * z, 1 - z, out=to[:, 0])
    np.multiply(to_n, r, out=to[:, 2])
    np.multiply(to[:, 2] * (0.5 * held[:, 2 * d:]), 1 - r, out=to[:, 1])
    da = np.empty_like(to)
    back = np.zeros((d, streams), kind)
    for t in reversed(range(steps)):
        g = dh[t]
        g += back
        np.multiply(g, to[t], out=da[t])
        np.matmul(w["u"], da[t].reshape(3 * d, streams), out=back)
        back += g * z[t]
        back *= going[t]
    da = da.reshape(steps, 3 * d, streams)
    grad["u"] = np.matmul(before, da.transpose(0, 2, 1)).sum(axis=0)
    grad["x"] = np.zeros_like(x)
    some = max(1, CHUNK // 2 // streams)
    for t in range(0, steps, some):  # the inputs' part: pieces that stay in the cache
        part = da[t:t + some]
        np.multiply(dh[t:t + some], to_n[t:t + some], out=part[:, 2 * d:])
        add_by_word(grad["x"], part.transpose(0, 2, 1).reshape(-1, 3 * d), ids[t:t + some].ravel())
    return grad, h.T, float(loss) / n


def add_by_word(out: np.ndarray, rows: np.ndarray, words: np.ndarray) -> None:
    """Add each row to that of its word."""
    order = np.argsort(words.astype(np.uint16 if len(out) < 1 << 16 else np.int64), kind="stable")
    words = words[order]
    first = np.flatnonzero(np.diff(words, prepend=-1))
    out[words[first]] += np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def train(w: dict, stream: np.ndarray, start: int, streams: int = 32, rate: float = 0.01) -> tuple[dict, float]:
    """One pass of truncated backpropagation (Adam) over a run of texts, each closed by ``start``; mean loss."""
    flat = np.concatenate([v.ravel() for v in w.values()])
    cuts = np.cumsum([v.size for v in w.values()])
    w = {k: x.reshape(v.shape) for (k, v), x in zip(w.items(), np.split(flat, cuts[:-1]))}  # views of one vector
    streams = max(1, min(streams, len(stream) // (2 * WINDOW)))
    length = len(stream) // streams
    goal = stream[:streams * length].reshape(streams, length).T
    ids = np.concatenate([np.full((1, streams), start), goal[:-1]])
    one, two = np.zeros_like(flat), np.zeros_like(flat)  # the sums behind both moments, without their factors 0.1 and 0.01
    h, losses = np.zeros((streams, w["u"].shape[0]), np.float32), []
    for i, t in enumerate(range(0, length, WINDOW), 1):
        x, y = ids[t:t + WINDOW], goal[t:t + WINDOW]
        grad, h, loss = gradient(w, h, x, y, x == start)
        losses.append(loss)
        all_g = np.concatenate([grad[k].ravel() for k in w])
        all_g *= np.float32(min(1.0, 1.0 / max(float(np.sqrt(np.vdot(all_g, all_g))), 1e-9)))
        fall, rise = np.float32(0.1 * rate / (1 - 0.9 ** i)), np.float32(0.01 / (1 - 0.99 ** i))
        for b in range(0, len(flat), BLOCK):
            at = slice(b, b + BLOCK)
            g, m, v = all_g[at], one[at], two[at]
            m *= np.float32(0.9)
            m += g
            g *= g
            v *= np.float32(0.99)
            v += g
            np.multiply(v, rise, out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= fall
            flat[at] -= g
    return w, float(np.mean(losses)) if losses else 0.0
