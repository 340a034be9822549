"""A small causal self-attention language model in numpy.

Symbols are subword ids by falling count; one symbol stands for all rarer ids
and one for the end of a text. Symbols fall into classes of about equal mass,
and log p(next) is the sum of

* a softmax over classes: the logarithm of how often the class follows the last
  symbol and the class of the one before, counted over all training texts, plus
  ``h @ out``, where ``h`` is what causal attention gathers from the symbols before;
* the symbol's share of its class after the last symbol, counted likewise.

Counts are smoothed by the number of kinds that follow (Witten and Bell), so both
parts sum to one. A text is cut into blocks of ``BLOCK`` symbols. The symbols of
a block are scored together, each attending to those before it in its own block
and to the whole previous block: windows overlap, every symbol is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK, WIDTH, CLASSES = 16, 16, 64
#: Ids that are symbols of their own.
SYMBOLS = 4096
#: Blocks of a training step; blocks whose arrays fit into a core's cache in training and in scoring.
STEP, LEARNED, CACHED = 512, 128, 256
#: Symbols of a text that are laid out together, a multiple of BLOCK.
PIECE = 1 << 16
#: A shard of fewer steps than these is passed over again, this often at most.
LEAST_STEPS, PASSES = 100, 4
#: First rate of training, and the steps after which it has fallen to a half.
RATE, HALF = 0.02, 60
#: Parameters are summed as integers of this unit, so that order doesn't matter.
UNIT = 1 << 32
#: What is added to attention scores of the future, and a bound below which exp fits a float without a shift.
_FUTURE, _SAFE = np.float32(-1e9), 80
_AGO = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)


class Vocabulary:
    """Symbols 0.. of the ``size`` most frequent ids, then OTHER and END."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, texts: int, all_ids: int, size: int = SYMBOLS):
        order = np.lexsort((ids, -counts))[:size]
        kept = ids[order]
        self.other, self.end = len(kept), len(kept) + 1
        rest = np.setdiff1d(ids, kept)
        mass = counts[order].tolist() + [counts.sum() - counts[order].sum() + 0.5, texts + 0.5]
        self.mass = np.maximum(np.array(mass, float), 0.5)
        self.symbol = np.full(all_ids, self.other, np.uint16)
        self.symbol[kept] = np.arange(len(kept))
        # a rarer id's share of OTHER; ids never seen share as much as once-seen ones have kinds
        share = np.zeros(all_ids)
        share[rest] = counts[np.searchsorted(ids, rest)]
        unseen = np.ones(all_ids, bool)
        unseen[ids] = False
        share[unseen] = max(len(rest), 1) / max(unseen.sum(), 1)
        self.share = np.zeros(all_ids)
        np.log(share / max(share.sum(), 1e-9), out=self.share, where=share > 0)
        # classes of about equal mass over symbols by falling mass
        by_mass = np.argsort(-self.mass, kind="stable")
        place = np.cumsum(self.mass[by_mass]) / self.mass.sum()
        cut = np.unique(np.minimum((place * CLASSES).astype(int), CLASSES - 1), return_inverse=True)[1]
        self.class_of = np.zeros(len(self.mass), np.int64)
        self.class_of[by_mass] = cut
        self.classes = int(cut.max()) + 1


def _small(x: np.ndarray, bound: int) -> np.ndarray:
    return x.astype(np.int32 if bound < 1 << 31 else np.int64)


class Follows:
    """How often symbols follow each other, as smoothed logarithms.

    ``pairs`` are sorted numbers (last symbol * symbols + next), ``n`` their counts;
    ``cells`` are numbers (context * classes + class of next), see :meth:`context`.
    """

    def __init__(self, v: Vocabulary, pairs: np.ndarray, n: np.ndarray, cells: np.ndarray, times: np.ndarray):
        size, classes = len(v.mass), v.classes
        # every worker holds these, so they take four bytes each where that is enough
        self.v, self.pairs, self.cells = v, _small(pairs, size * size), _small(cells, size * classes * classes)
        self.n, self.times = (_small(x, int(x.max(initial=0))) for x in (n, times))
        last, after = np.divmod(pairs, size)
        cell = last * classes + v.class_of[after]
        self.seen = np.bincount(cell, self.n, size * classes).reshape(size, classes)
        self.kinds = np.maximum(np.bincount(cell, minlength=size * classes).reshape(size, classes), 1)
        self.of_class = np.bincount(v.class_of, v.mass, classes)
        self.within = v.mass / self.of_class[v.class_of]
        self._class_log: np.ndarray | None = None
        self._index: tuple[np.ndarray, np.ndarray] | None = None

    def context(self, own: np.ndarray) -> np.ndarray:
        """Of each symbol from the second on: itself and the class of the one before, as a number."""
        return own[1:].astype(np.int64) * self.v.classes + self.v.class_of[own[:-1]]

    @property
    def class_log(self) -> np.ndarray:
        """log p(class of next | context) by context; made where it is first used."""
        if self._class_log is None:
            classes = self.v.classes
            kinds = np.maximum((self.seen > 0).sum(1, keepdims=True), 1)
            short = (self.seen + kinds * self.of_class / self.of_class.sum()) / (self.seen.sum(1, keepdims=True) + kinds)
            out = np.empty((len(short) * classes, classes), np.float32)
            for lo in range(0, len(short), 64):
                hi = min(len(short), lo + 64)
                part = np.zeros(((hi - lo) * classes, classes))
                a, b = np.searchsorted(self.cells, np.array((lo * classes * classes, hi * classes * classes), self.cells.dtype))
                part.ravel()[self.cells[a:b] - lo * classes * classes] = self.times[a:b]
                kinds = np.maximum((part > 0).sum(1, keepdims=True), 1)
                total = part.sum(1, keepdims=True) + kinds
                part += kinds * np.repeat(short[lo:hi], classes, 0)
                part /= total
                out[lo * classes : hi * classes] = np.log(part)
            self._class_log = out
        return self._class_log

    @property
    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """A bit for each pair that may occur, and how many occur before each 64 of them and in all; made where it is first used."""
        if self._index is None:
            words = np.zeros(len(self.v.mass) ** 2 // 64 + 1, np.uint64)
            for lo in range(0, len(self.pairs), 1 << 16):
                part = self.pairs[lo : lo + (1 << 16)]
                word, first = np.unique(part >> 6, return_index=True)
                words[word] |= np.bitwise_or.reduceat(np.uint64(1) << (part & 63).astype(np.uint64), first)
            self._index = words, np.cumsum(np.append(0, np.bitwise_count(words)), dtype=np.int32)
        return self._index

    def share(self, last: np.ndarray, after: np.ndarray) -> np.ndarray:
        """p(next | its class, last) of pairs, found among those that occur: no table of all pairs is held."""
        words, before = self.index
        keys = last.astype(np.uint32) * np.uint32(len(self.v.mass)) + after.astype(np.uint32)
        word, bit = keys >> np.uint32(6), (keys & np.uint32(63)).astype(np.uint64)
        own = words.take(word) >> bit
        there = own & np.uint64(1)
        # pairs from this one on in its 64, so the place of the pair itself if it occurs
        place = before.take(word + np.uint32(1)) - np.bitwise_count(own)
        n = self.n.take(place, mode="clip") * there.astype(self.n.dtype) if len(self.n) else np.zeros(len(keys))
        cell = last.astype(np.int64) * self.v.classes + self.v.class_of.take(after)
        kinds = self.kinds.ravel().take(cell)
        return (n + kinds * self.within.take(after)) / (self.seen.ravel().take(cell) + kinds)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_class_log": None, "_index": None}


def laid_out(texts: Iterator[np.ndarray], end: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: inputs and targets (n, BLOCK), and each row's text, ``rows`` or a little more at a time.

    Before a text, or a piece of one, stands the block of what comes before it,
    whose targets are -1; a window is a block and the one above it.
    """
    held, size = [], 0
    for i, symbols in enumerate(texts):
        n = len(symbols) + 1
        for at in range(0, n, PIECE):
            m = min(PIECE, n - at)
            own = np.full((-(-m // BLOCK) + 1) * BLOCK, end, np.int32)
            goal = np.full(len(own), -1, np.int32)
            first = max(0, at - BLOCK - 1)
            before = symbols[first : at + m - 1]
            own[BLOCK + m - len(before) : BLOCK + m] = before
            after = symbols[at : at + m]
            goal[BLOCK : BLOCK + len(after)] = after
            if len(after) < m:
                goal[BLOCK + len(after)] = end
            held.append((own, goal, i))
            size += len(own) // BLOCK
            if size >= rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, goal = (np.concatenate([h[k] for h in held]).reshape(-1, BLOCK) for k in (0, 1))
    return own, goal, np.repeat([h[2] for h in held], [len(h[0]) // BLOCK for h in held])


def _windows(x: np.ndarray) -> np.ndarray:
    """(n - 1, 2 * BLOCK, width) over n blocks of rows of ``x``, without copying."""
    n, step = len(x) // BLOCK, x.strides[0]
    return np.lib.stride_tricks.as_strided(x, (n - 1, 2 * BLOCK, x.shape[1]), (BLOCK * step, step, x.strides[1]))


class Model:
    def __init__(self, follows: Follows, seed: int = 7):
        r, c = np.random.default_rng(seed), follows.v.classes

        def some(*shape: int, scale: float) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.v, self.follows = follows.v, follows
        self.p = {
            "embed": some(len(follows.v.mass), WIDTH, scale=0.5), "q": some(WIDTH, WIDTH, scale=WIDTH**-0.5), "k": some(WIDTH, WIDTH, scale=WIDTH**-0.5),
            "v": some(WIDTH, WIDTH, scale=WIDTH**-0.5), "ago": (-0.2 * np.arange(2 * BLOCK)).astype(np.float32), "out": np.zeros((WIDTH, c), np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, x in self.p.items():
            self.p[name] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def bias(self) -> np.ndarray:
        return np.where(_AGO < 0, _FUTURE, self.p["ago"][np.maximum(_AGO, 0)])

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries with keys, scaled, and values with ``out`` as one matrix each: rows of ``embed`` are keys and values then."""
        return self.p["q"] @ self.p["k"].T * np.float32(WIDTH**-0.5), self.p["v"] @ self.p["out"]

    def tables(self) -> tuple:
        """By symbol: what asks, what is asked; what gives classes; the bias by distance; whether exp needs a shift."""
        turn, out = self.joined()
        q, x = self.p["embed"] @ turn, self.p["embed"]
        return q, x, out, self.bias(), self.large(q, x)

    def large(self, q: np.ndarray, k: np.ndarray) -> bool:
        """Whether attention scores may be too large for exp."""
        return float(np.sqrt(np.einsum("ij,ij->i", q, q).max() * np.einsum("ij,ij->i", k, k).max()) + np.abs(self.p["ago"]).max()) > _SAFE

    def score(self, inputs: np.ndarray, targets: np.ndarray, tables: tuple) -> np.ndarray:
        """Natural log-probability of each block's targets together; 0 for a block without."""
        q, x, gives, bias, large = tables
        out = np.zeros(len(inputs))
        class_log, classes = self.follows.class_log, self.v.classes
        ones = np.ones(2 * BLOCK + classes, np.float32)
        for lo in range(0, len(inputs) - 1, CACHED):
            own, goal = inputs[lo : lo + CACHED + 1].ravel(), targets[lo + 1 : lo + CACHED + 1].ravel()
            last = own[BLOCK:]
            near = _windows(x.take(own, 0))
            a = np.matmul(q.take(last, 0).reshape(-1, BLOCK, WIDTH), near.transpose(0, 2, 1))
            a += bias
            if large:
                a -= a.max(-1, keepdims=True)
            np.exp(a, out=a)
            h = np.matmul(a, near).reshape(-1, WIDTH)
            h /= (a.reshape(-1, 2 * BLOCK) @ ones[: 2 * BLOCK])[:, None]
            logit = h @ gives
            logit += class_log.take(self.follows.context(own[BLOCK - 1 :]), 0)
            there = np.flatnonzero(goal >= 0)
            seen = goal[there]
            got = logit.ravel().take(there * classes + self.v.class_of.take(seen)).astype(np.float64)
            np.exp(logit, out=logit)
            got += np.log(self.follows.share(last[there], seen) / (logit @ ones[2 * BLOCK :])[there])
            out[lo + 1 : lo + 1 + len(goal) // BLOCK] = np.bincount(there // BLOCK, got, len(goal) // BLOCK)
        return out

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the classes per weighted target, and its gradient. ``weight`` is by block."""
        p = self.p
        d = {name: np.zeros_like(x) for name, x in p.items()}
        n = ((targets[1:] >= 0).sum(1) * weight[1:]).sum()
        if not n:
            return 0.0, d
        dx, loss = np.zeros((inputs.size, WIDTH), p["embed"].dtype), 0.0
        turn, out = self.joined()
        given = turn, out, self.bias(), self.large(p["embed"] @ turn, p["embed"])
        d_turn, d_out, d_bias = (np.zeros_like(x) for x in given[:3])
        for lo in range(0, len(inputs) - 1, LEARNED):
            part = slice(lo, lo + LEARNED + 1)
            loss += self._add_gradient(inputs[part], targets[part], weight[part] / n, given, (d_turn, d_out, d_bias, dx[lo * BLOCK : (lo + LEARNED + 1) * BLOCK]))
        scale = np.float32(WIDTH**-0.5)
        d["q"], d["k"] = d_turn @ p["k"] * scale, d_turn.T @ p["q"] * scale
        d["v"], d["out"] = d_out @ p["out"].T, p["v"].T @ d_out
        d["ago"] = np.bincount(np.maximum(_AGO, 0).ravel(), np.where(_AGO < 0, 0, d_bias).ravel(), 2 * BLOCK).astype(p["ago"].dtype)
        own = inputs.ravel()
        for at, column in enumerate(np.ascontiguousarray(dx.T)):
            d["embed"][:, at] = np.bincount(own, column, len(d["embed"]))
        return loss, d

    def _add_gradient(self, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray, given: tuple, d: tuple) -> float:
        """Loss of some windows; adds to the gradients ``d``: of both matrices of :meth:`joined`, of the bias, and by position."""
        (turn, out, bias, large), (d_turn, d_out, d_bias, dx) = given, d
        own, kind = inputs.ravel(), turn.dtype
        x = self.p["embed"].take(own, 0)
        near, asks = _windows(x), x[BLOCK:]
        n, rows = len(near), len(asks)
        # attention beside its gradient, and what asks beside the gradient of what it gets, so that each pair is one matrix below
        both, sides = np.empty((n, 2, BLOCK, 2 * BLOCK), kind), np.empty((n, 2, BLOCK, WIDTH), kind)
        a, da, q, g = both[:, 0], both[:, 1], sides[:, 1], sides[:, 0]
        q[...] = (asks @ turn).reshape(q.shape)
        np.matmul(q, near.transpose(0, 2, 1), out=a)
        a += bias
        if large:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        h = np.matmul(a, near).reshape(-1, WIDTH)
        part = 1 / np.matmul(a, np.ones(2 * BLOCK, kind)).reshape(rows, 1)
        h *= part
        logit = h @ out
        logit += self.follows.class_log.take(self.follows.context(own[BLOCK - 1 :]), 0)
        np.exp(logit, out=logit)
        total = logit @ np.ones(logit.shape[1], kind)
        goal = targets[1:].ravel()
        counted = np.where(goal >= 0, np.repeat(weight[1:], BLOCK), 0).astype(kind)
        at = np.arange(0, logit.size, logit.shape[1]) + self.v.class_of.take(goal, mode="clip")
        flat = logit.ravel()
        chance = flat.take(at)
        loss = -(counted * np.log(np.maximum(chance, np.finfo(kind).tiny) / total)).sum()
        flat[at] = chance - total
        counted = (counted / total)[:, None]
        dh = logit @ out.T
        dh *= counted
        counted = counted * h
        d_out += counted.T @ logit
        dh *= part
        g[...] = dh.reshape(g.shape)
        np.matmul(g, near.transpose(0, 2, 1), out=da)
        da *= a
        # a row's mean gradient is not taken from each score in it, but from what the scores are multiplied with
        mean = np.einsum("ij,ij->i", dh, h)
        g -= mean.reshape(n, BLOCK, 1) * q
        asked = np.matmul(both.reshape(n, 2 * BLOCK, 2 * BLOCK).transpose(0, 2, 1), sides.reshape(n, 2 * BLOCK, WIDTH))
        dq = np.matmul(da, near).reshape(-1, WIDTH)
        dq -= (mean[:, None] / part) * h
        by_distance = np.ones(n, kind) @ both.reshape(n, -1)[:, 2 * BLOCK * BLOCK :]
        by_distance -= np.einsum("ni,nij->ij", mean.reshape(n, BLOCK), a).ravel()
        d_bias += by_distance.reshape(_AGO.shape)
        d_turn += asks.T @ dq
        by_block = dx.reshape(-1, BLOCK, WIDTH)
        by_block[:-1] += asked[:, :BLOCK]
        by_block[1:] += asked[:, BLOCK:]
        dx[BLOCK:] += dq @ turn.T
        return float(loss)


class Adam:
    """Adam over the model's parameters, at a rate that falls with the steps done."""

    def __init__(self, model: Model, rate: float = RATE, half: float = HALF):
        self.model, self.rate, self.half, self.t = model, rate, half, 0
        self.m = {k: np.zeros_like(x) for k, x in model.p.items()}
        self.s = {k: np.zeros_like(x) for k, x in model.p.items()}

    def step(self, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> float:
        loss, d = self.model.gradient(inputs, targets, weight)
        self.t += 1
        rate = np.float32(self.rate / (1 + self.t / self.half) * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k, g in d.items():
            m, s = self.m[k], self.s[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            s *= np.float32(0.99)
            g *= g
            s += np.float32(0.01) * g
            x = np.sqrt(s)
            x += np.float32(1e-7)
            np.divide(m, x, out=x)
            x *= rate
            self.model.p[k] -= x
        return loss


def trained(model: Model, texts: Iterator[tuple[np.ndarray, int]]) -> tuple[np.ndarray, int]:
    """Parameters of a copy of ``model`` that saw all ``texts`` (symbols, times), and targets seen."""
    own = Model(model.follows)
    own.load(model.flat())
    adam, seen, steps, times = Adam(own), 0, 0, {}
    held: list[tuple] | None = []

    def symbols() -> Iterator[np.ndarray]:
        for i, (one, n) in enumerate(texts):
            times[i] = n
            yield one

    def learn(inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> int:
        rows = len(inputs) - 1
        size = -(-rows // max(1, round(rows / STEP)))
        for at in range(0, rows, size):
            part = slice(at, at + size + 1)
            adam.step(inputs[part], targets[part], weight[part])
        return -(-rows // size)

    for inputs, targets, owner in laid_out(symbols(), own.v.end, STEP):
        weight = np.array([times[i] for i in owner], np.float32)
        steps += learn(inputs, targets, weight)
        seen += int((targets >= 0).sum())
        for i in range(owner[0], owner[-1]):
            times.pop(i, None)
        if steps >= LEAST_STEPS:
            held = None
        elif held is not None:
            held.append((inputs, targets, weight))
    for _ in range(PASSES - 1):
        if held and adam.t < LEAST_STEPS:
            for part in held:
                learn(*part)
    return own.flat(), seen
