"""A gated recurrent network over symbols with a class-factored softmax, in numpy.

Symbols are numbered 0 .. S - 1. Each belongs to one class, and P(symbol | state) = P(class | state) * P(symbol | class,
state), so a token costs the classes and the members of one class instead of all symbols. Training is truncated
backpropagation: gradients run back over one window of WINDOW steps, the state is carried on to the next window and
starts from zero at the first token of a document. Scoring carries the state through the whole document.

Documents are dealt to lanes of nearly equal length and all lanes step together.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, CLASSES, WINDOW = 16, 32, 32
TRAIN_LANES, SCORE_LANES = 256, 512
RATE, CLIP = 0.05, 1.0
#: A longer document is learnt in segments, each from an empty state, so that it does not keep one lane alone at work.
SEGMENT = 2_048


def class_of(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of every symbol: symbol 0 alone, the others by equal shares of the summed roots of their counts."""
    order = np.argsort(-counts[1:], kind="stable") + 1
    weight = np.sqrt(np.maximum(counts[order], 1.0))
    share = (np.cumsum(weight) - weight) / max(weight.sum(), 1e-9)
    out = np.zeros(len(counts), np.int32)
    out[order] = 1 + np.minimum((share * (classes - 1)).astype(np.int32), classes - 2)
    return np.unique(out, return_inverse=True)[1].astype(np.int32)


def lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Documents dealt to at most `most` lanes, longest first to the shortest lane."""
    heap = [(0, k) for k in range(min(most, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, k = heap[0]
        out[k].append(d)
        heapq.heapreplace(heap, (size + int(lengths[d]), k))
    return out


def exp_sums(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(logits) and its row sums, up to a factor of each row that ends up in both; logits are changed to match."""
    logits -= logits.max()  # one maximum for all is many times faster than one a row
    e = np.exp(logits)
    total = e @ np.ones(e.shape[1], np.float32)
    low = np.flatnonzero(total < 1e-25)
    if len(low):
        own = logits[low] - logits[low].max(axis=1, keepdims=True)
        logits[low], e[low] = own, np.exp(own)
        total[low] = e[low].sum(axis=1)
    return e, total


class Model:
    """Parameters by name in self.p; input symbol before the first token of a document is `start`."""

    def __init__(self, counts: np.ndarray, start: int, seed: int = 11) -> None:
        counts = np.asarray(counts, np.float64) + 1.0
        self.start, self.symbols = start, len(counts)
        self.cls = class_of(counts)
        self.members = [np.flatnonzero(self.cls == k) for k in range(self.cls.max() + 1)]
        self.within = np.zeros(self.symbols, np.int64)
        for m in self.members:
            self.within[m] = np.arange(len(m))
        rng, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(h)).astype(np.float32)
        mass = np.array([counts[m].sum() for m in self.members])
        self.offsets = np.concatenate([[0], np.cumsum([len(m) for m in self.members])])
        flat = np.concatenate(self.members)
        self.p = {
            "input": 0.3 * draw(self.symbols, 3 * h),
            "state": draw(h, 3 * h),
            "class_w": 0.1 * draw(h, len(self.members)),
            "class_b": np.log(mass / mass.sum()).astype(np.float32),
            "word_w": 0.1 * draw(h, self.symbols),  # columns by class, as in flat
            "word_b": np.log(counts[flat] / mass[self.cls[flat]]).astype(np.float32),
        }
        self.g2 = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}

    # ---- parameters as one vector -------------------------------------------------------------------------------

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for d in (self.p, self.g2) for x in d.values()])

    def unpack(self, flat: np.ndarray) -> Model:
        at = 0
        for d in (self.p, self.g2):
            for k, x in d.items():
                d[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        return self

    # ---- one window ---------------------------------------------------------------------------------------------

    def _steps(self, given: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool):
        """States after each step of given (steps, lanes); first marks steps that begin a document."""
        n, (steps, width) = HIDDEN, given.shape
        x, u = self.p["input"][given], self.p["state"]
        states = np.empty((steps, width, n), np.float32)
        trace = []
        starts = first.any(axis=1)
        for t in range(steps):
            if starts[t]:
                h = np.where(first[t][:, None], np.float32(0), h)
            a, xt = h @ u, x[t]
            zr = xt[:, : 2 * n] + a[:, : 2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            r = zr[:, n:]
            c = np.tanh(xt[:, 2 * n :] + r * a[:, 2 * n :])
            z = zr[:, :n]
            new = c + z * (h - c)
            if keep:
                trace.append((h, a, zr, c))
            states[t] = h = new
        return states, h, trace

    def _output(self, s: np.ndarray, target: np.ndarray, learn: bool):
        """Log probabilities of targets given states s (tokens, HIDDEN); with learn also gradients of their negative sum."""
        p = self.p
        logits = s @ p["class_w"] + p["class_b"]
        e, total = exp_sums(logits)
        cls, rows = self.cls[target], np.arange(len(target))
        out = logits[rows, cls] - np.log(total)
        grads, ds = {}, None
        if learn:
            e /= total[:, None]
            e[rows, cls] -= 1
            ds = e @ p["class_w"].T
            grads = {"class_w": s.T @ e, "class_b": e.sum(axis=0), "word_w": np.zeros_like(p["word_w"]), "word_b": np.zeros_like(p["word_b"])}
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(cls, minlength=len(self.members)))
        begin = 0
        for k, end in enumerate(ends.tolist()):
            if end > begin and len(self.members[k]) > 1:
                own, a, b = order[begin:end], self.offsets[k], self.offsets[k + 1]
                w, sk, at = p["word_w"][:, a:b], s[own], self.within[target[own]]
                l = sk @ w + p["word_b"][a:b]
                e, total = exp_sums(l)
                i = np.arange(end - begin)
                out[own] += l[i, at] - np.log(total)
                if learn:
                    e /= total[:, None]
                    e[i, at] -= 1
                    ds[own] += e @ w.T
                    grads["word_w"][:, a:b], grads["word_b"][a:b] = sk.T @ e, e.sum(axis=0)
            begin = end
        return out, ds, grads

    def _learn(self, given: np.ndarray, target: np.ndarray, first: np.ndarray, used: np.ndarray, h: np.ndarray) -> np.ndarray:
        n, u = HIDDEN, self.p["state"]
        states, last, trace = self._steps(given, first, h, True)
        where = np.flatnonzero(used.ravel())
        _, ds, grads = self._output(states.reshape(-1, n)[where], target.ravel()[where], True)
        outer = np.zeros((used.size, n), np.float32)
        outer[where] = ds
        outer = outer.reshape(states.shape)
        dx = np.empty((*given.shape, 3 * n), np.float32)
        du, dh = np.zeros_like(u), np.zeros_like(h)
        starts = first.any(axis=1)
        for t in range(len(given) - 1, -1, -1):
            before, a, zr, c = trace[t]
            z, r = zr[:, :n], zr[:, n:]
            dh += outer[t]
            d = dx[t]
            dc = dh * (1 - z) * (1 - c * c)
            d[:, :n] = dh * (before - c) * z * (1 - z)
            d[:, n : 2 * n] = dc * a[:, 2 * n :] * r * (1 - r)
            da = d.copy()
            d[:, 2 * n :] = dc
            da[:, 2 * n :] = dc * r
            du += before.T @ da
            dh = dh * z + da @ u.T
            if starts[t]:
                dh[first[t]] = 0
        ids, flat = given.ravel()[where], dx.reshape(-1, 3 * n)[where]
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        seen, at = np.unique(ids[order], return_index=True)
        rows = np.add.reduceat(flat[order], at, axis=0)
        grads["state"] = du
        scale = np.float32(1.0 / max(1, len(where)))
        size = np.sqrt(sum(float((g * g).sum()) for g in (*grads.values(), rows))) * scale
        scale *= np.float32(min(1.0, CLIP / max(size, 1e-9)))
        for k, g in grads.items():
            g *= scale
            self.g2[k] += g * g
            self.p[k] -= RATE * g / np.sqrt(self.g2[k])
        rows *= scale
        self.g2["input"][seen] += rows * rows
        self.p["input"][seen] -= RATE * rows / np.sqrt(self.g2["input"][seen])
        return last

    # ---- documents ----------------------------------------------------------------------------------------------

    def _windows(self, docs: list[np.ndarray], heads: np.ndarray, width: int):
        """(lanes on, given, target, first, doc) of every window, the last four as (steps, lanes); doc is -1 past a lane's
        end. heads: the symbol before each document."""
        own = lanes(np.array([len(d) for d in docs]), width)
        order = [d for mine in own for d in mine]
        sizes = np.array([len(docs[d]) for d in order])
        target = np.concatenate([docs[d] for d in order]).astype(np.int32)
        doc = np.repeat(np.array(order, np.int32), sizes)
        first = np.zeros(len(target), bool)
        first[np.cumsum(sizes) - sizes] = True
        given = np.concatenate([target[:1], target[:-1]])
        given[first] = heads[order]
        length = np.array([sum(len(docs[d]) for d in mine) for mine in own])
        begin = np.cumsum(length) - length
        for t in range(0, int(length.max()), WINDOW):
            on = np.flatnonzero(length > t)  # lanes that have ended leave
            step = np.arange(t, min(t + WINDOW, int(length.max())))[:, None]
            used = step < length[on]
            at = np.where(used, begin[on] + step, 0)
            yield on, given[at], target[at], first[at] & used, np.where(used, doc[at], -1)

    def train(self, docs: list[np.ndarray]) -> int:
        """One pass over documents (arrays of symbols, none empty); returns the tokens seen."""
        parts = [d[k : k + SEGMENT] for d in docs for k in range(0, len(d), SEGMENT)]
        heads = np.array([d[k - 1] if k else self.start for d in docs for k in range(0, len(d), SEGMENT)])
        h = np.zeros((min(TRAIN_LANES, len(parts)), HIDDEN), np.float32)
        for on, given, target, first, doc in self._windows(parts, heads, TRAIN_LANES):
            h[on] = self._learn(given, target, first, doc >= 0, h[on])
        return sum(map(len, docs))

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of every document."""
        out, h = np.zeros(len(docs)), np.zeros((min(SCORE_LANES, len(docs)), HIDDEN), np.float32)
        for on, given, target, first, doc in self._windows(docs, np.full(len(docs), self.start), SCORE_LANES):
            states, h[on], _ = self._steps(given, first, h[on], False)
            where = np.flatnonzero(doc.ravel() >= 0)
            found, _, _ = self._output(states.reshape(-1, HIDDEN)[where], target.ravel()[where], False)
            out += np.bincount(doc.ravel()[where], weights=found, minlength=len(docs))
        return out
