"""A character-level bidirectional LSTM with CRF transitions, in numpy.

It is trained from labelled spans. Both directions run as one stacked
computation over a batch of equally long windows. A `Scheme` says which tags a
character can have, which can follow each other, and which moves are barred
inside a word; the CRF gives all else probability zero, in training as in
decoding.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Symbols: 0 padding, 1-94 printable ASCII, 96 white space, 97 other letters, 98 all else.
N_SYMBOLS = 99
_NO = -1e4


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((codes > 32) & (codes < 127), codes - 32, 98)
    out[(codes == 32) | ((codes >= 9) & (codes <= 13))] = 96
    for i in np.flatnonzero(codes >= 128).tolist():
        if text[i].isalpha():
            out[i] = 97
    return out


def symbol_set(chars: str, *more: int) -> np.ndarray:
    """A mask over symbols: those of printable ASCII characters, and others by number."""
    out = np.zeros(N_SYMBOLS, bool)
    out[[ord(c) - 32 for c in chars] + list(more)] = True
    return out


@dataclass(frozen=True)
class Scheme:
    """Tags from 0 (outside). All arrays are masks of what is possible."""

    #: (symbol, tag)
    can: np.ndarray
    #: (tag, next tag)
    follow: np.ndarray
    #: (tag, next tag) where both characters belong to one word.
    inside: np.ndarray
    #: Symbols that words are made of.
    word: np.ndarray
    #: Tags that a text can begin and end with.
    first: np.ndarray
    last: np.ndarray

    @property
    def tags(self) -> int:
        return len(self.first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    scheme: Scheme
    width: int = 14
    hidden: int = 24
    seed: int = 3
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if self.w:
            return
        rng, d, h, n = np.random.default_rng(self.seed), self.width, self.hidden, self.scheme.tags
        put = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.w = {
            "embed": put(N_SYMBOLS, d), "wx": put(2, d, 4 * h), "wh": put(2, h, 4 * h), "b": np.zeros((2, 1, 4 * h), np.float32),
            "out": put(2, h, n), "bias": np.zeros(n, np.float32), "move": np.zeros((n, n), np.float32),
        }
        self.w["b"][:, :, h : 2 * h] = 1

    def joined(self, x: np.ndarray) -> np.ndarray:
        """Along the first axis: whether a symbol and the one before it belong to one word."""
        word = self.scheme.word[x]
        return np.concatenate([np.zeros_like(word[:1]), word[1:] & word[:-1]])

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x (time, batch) -> scores (time, batch, tags), and what training needs."""
        w, h = self.w, self.hidden
        both = np.stack([x, x[::-1]], 1)
        gates = w["embed"][both] @ w["wx"] + w["b"]
        steps, batch = x.shape
        hs = np.zeros((steps, 2, batch, h), np.float32)
        hidden, cell, saved = np.zeros((2, batch, h), np.float32), np.zeros((2, batch, h), np.float32), []
        for t in range(steps):
            g = gates[t] + hidden @ w["wh"]
            s, new = _sigmoid(g[..., : 3 * h]), np.tanh(g[..., 3 * h :])
            before = cell
            cell = s[..., h : 2 * h] * cell + s[..., :h] * new
            bent = np.tanh(cell)
            if keep:
                saved.append((s, new, before, bent, hidden))
            hidden = s[..., 2 * h :] * bent
            hs[t] = hidden
        emit = hs[:, 0] @ w["out"][0] + hs[::-1, 1] @ w["out"][1] + w["bias"]
        return (emit, hs, saved, both) if keep else emit

    def _crf(self, emit: np.ndarray, x: np.ndarray, y: np.ndarray):
        """Negative log-likelihoods (batch), and the gradients by the emissions and the moves."""
        steps, batch, n = emit.shape
        scheme, move = self.scheme, self.w["move"].astype(np.float64)
        top = emit.max(2, keepdims=True)
        e = np.exp(emit.astype(np.float64) - top) * scheme.can[x]
        ways = [np.exp(move) * scheme.follow, np.exp(move) * scheme.inside]
        within = self.joined(x)
        ahead, scale = np.empty((steps, batch, n)), np.empty((steps, batch, 1))
        now = e[0]
        for t in range(steps):
            if t:
                now = np.where(within[t][:, None], now @ ways[1], now @ ways[0]) * e[t]
            scale[t] = now.sum(1, keepdims=True)
            ahead[t] = now = now / scale[t]
        back = np.ones((steps, batch, n))
        for t in range(steps - 2, -1, -1):
            seen = e[t + 1] * back[t + 1] / scale[t + 1]
            back[t] = np.where(within[t + 1][:, None], seen @ ways[1].T, seen @ ways[0].T)
        total = (np.log(scale) + top).sum((0, 2))
        rows = np.arange(batch)
        gold = np.take_along_axis(emit, y[..., None], 2).sum((0, 2)) + move[y[:-1], y[1:]].sum(0)
        de = ahead * back
        de[np.arange(steps)[:, None], rows[None, :], y] -= 1
        seen = (e * back / scale)[1:]
        dm = np.zeros((n, n))
        for k, way in enumerate(ways):
            part = within[1:] == bool(k)
            dm += way * (ahead[:-1][part].T @ seen[part])
        np.add.at(dm, (y[:-1].ravel(), y[1:].ravel()), -1)
        return total - gold, de, dm

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags y (time, batch), and its gradients."""
        w, h = self.w, self.hidden
        emit, hs, saved, both = self.emissions(x, keep=True)
        steps, batch = x.shape
        lost, de, dm = self._crf(emit, x, y)
        de = (de / batch).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["move"] = (dm / batch).astype(np.float32)
        g["bias"] = de.sum((0, 1))
        rev = de[::-1]
        g["out"][0] = np.tensordot(hs[:, 0], de, ((0, 1), (0, 1)))
        g["out"][1] = np.tensordot(hs[:, 1], rev, ((0, 1), (0, 1)))
        dh_all = np.stack([de @ w["out"][0].T, rev @ w["out"][1].T], 1)
        dh, dc = np.zeros((2, batch, h), np.float32), np.zeros((2, batch, h), np.float32)
        dgates = np.empty((steps, 2, batch, 4 * h), np.float32)
        back = np.ascontiguousarray(w["wh"].swapaxes(1, 2))
        for t in range(steps - 1, -1, -1):
            s, new, before, bent, _ = saved[t]
            i, f, o = s[..., :h], s[..., h : 2 * h], s[..., 2 * h :]
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - bent * bent)
            d = dgates[t]
            d[..., :h], d[..., h : 2 * h], d[..., 2 * h : 3 * h] = dc * new, dc * before, dh * bent
            d[..., : 3 * h] *= s * (1 - s)
            d[..., 3 * h :] = dc * i * (1 - new * new)
            dh, dc = d @ back, dc * f
        hidden = np.stack([s[4] for s in saved])
        for k in (0, 1):
            g["wh"][k] = np.tensordot(hidden[:, k], dgates[:, k], ((0, 1), (0, 1)))
            g["wx"][k] = np.tensordot(w["embed"][both[:, k]], dgates[:, k], ((0, 1), (0, 1)))
        g["b"] = dgates.sum((0, 2))[:, None, :]
        d = self.width
        g["embed"] += np.eye(N_SYMBOLS, dtype=np.float32)[both.ravel()].T @ (dgates @ w["wx"].swapaxes(1, 2)).reshape(-1, d)
        return float(lost.mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.012) -> list[float]:
        """Adam over shuffled batches; x and y are (windows, time). Returns the loss of each epoch."""
        rng = np.random.default_rng(self.seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(a) for k, a in self.w.items()}
        steps, losses, total = 0, [], epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, lost = rng.permutation(len(x)), []
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                loss, g = self.gradients(x[part].T, y[part].T)
                norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
                steps += 1
                now = rate * (1 - 0.9 * steps / total)
                for k in self.w:
                    a = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    self.w[k] = self.w[k] - now * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.99**steps)) + 1e-8)
                lost.append(loss)
            losses.append(float(np.mean(lost)))
        self.w = {k: a.astype(np.float32) for k, a in self.w.items()}
        return losses

    def best_path(self, emit: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The best tag sequences (Viterbi) of whole texts; emit (time, batch, tags), x and the result (time, batch)."""
        scheme, (steps, batch, n) = self.scheme, emit.shape
        ways = [np.where(mask, self.w["move"], _NO) for mask in (scheme.follow, scheme.inside)]
        possible = np.where(scheme.can[x], emit, _NO)
        within = self.joined(x)
        score, came = possible[0] + np.where(scheme.first, 0, _NO), np.empty((steps, batch, n), np.int8)
        for t in range(1, steps):
            choices = score[:, :, None] + np.where(within[t][:, None, None], ways[1], ways[0])
            came[t] = choices.argmax(1)
            score = choices.max(1) + possible[t]
        out = np.empty((steps, batch), np.int8)
        out[-1] = (score + np.where(scheme.last, 0, _NO)).argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = came[t][rows, out[t]]
        return out
