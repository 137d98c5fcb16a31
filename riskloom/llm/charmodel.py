"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Tags are O and B-/I- of each kind. Both directions run as one batch of matrix
products, so a step over a window costs one product whatever the batch.
"""

from __future__ import annotations

import numpy as np

EMBED, HIDDEN = 10, 16
ENOUGH = 0.99             # share of held-out texts read right that ends training
N_CHARS = 99  # padding, 95 printable ASCII, white space, letter, anything else


def char_ids(text: str) -> list[int]:
    return [ord(c) - 31 if " " < c <= "~" else 96 if c.isspace() else 97 if c.isalpha() else 98 for c in text]


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, kinds: tuple[str, ...], seed: int = 7) -> None:
        self.kinds, self.n_tags = kinds, 1 + 2 * len(kinds)
        rng = np.random.default_rng(seed)
        s = 0.25
        self.p = {
            "emb": rng.normal(0, s, (N_CHARS, EMBED)),
            "wx": rng.normal(0, s, (2, EMBED, 4 * HIDDEN)),
            "wh": rng.normal(0, s, (2, HIDDEN, 4 * HIDDEN)),
            "b": np.zeros((2, 1, 4 * HIDDEN)),
            "out": rng.normal(0, s, (2 * HIDDEN, self.n_tags)),
            "ob": np.zeros(self.n_tags),
            "trans": np.zeros((self.n_tags, self.n_tags)),
        }
        self.p["b"][:, :, HIDDEN:2 * HIDDEN] = 1.0  # forget gates start open
        self.allowed = np.zeros((self.n_tags, self.n_tags))
        for k in range(len(kinds)):  # I-k only after B-k or I-k
            bad = [t for t in range(self.n_tags) if t not in (1 + 2 * k, 2 + 2 * k)]
            self.allowed[bad, 2 + 2 * k] = -1e4
        self.first = np.zeros(self.n_tags)
        self.first[2::2] = -1e4

    # -- network -----------------------------------------------------------
    def _flip(self, x, length):
        """The second direction reads each window from its own end."""
        t = np.arange(x.shape[1])
        at = np.where(t[None] < length[:, None], length[:, None] - 1 - t[None], t[None])
        return np.take_along_axis(x, at[..., None], axis=1), at

    def _forward(self, ids, length, keep=False):
        p = self.p
        e = p["emb"][ids]                                        # B T E
        back, at = self._flip(e, length)
        x = np.stack([e, back])                                  # 2 B T E
        gx = np.matmul(x.reshape(2, -1, EMBED), p["wx"]).reshape(2, *ids.shape, 4 * HIDDEN) + p["b"][:, None]
        n, width = ids.shape
        h, c = np.zeros((2, n, HIDDEN), x.dtype), np.zeros((2, n, HIDDEN), x.dtype)
        hs = np.empty((2, n, width, HIDDEN), x.dtype)
        tape = []
        half = np.repeat(np.array([0.5, 1.0], x.dtype), [3 * HIDDEN, HIDDEN])
        for t in range(width):
            g = gx[:, :, t] + np.matmul(h, p["wh"])
            act = np.tanh(g * half)  # a gate's sigmoid is (1 + tanh(x / 2)) / 2
            gates, u = 0.5 * act[..., :3 * HIDDEN] + 0.5, act[..., 3 * HIDDEN:]
            i, f, o = (gates[..., a * HIDDEN:(a + 1) * HIDDEN] for a in range(3))
            c_new = f * c + i * u
            tc = np.tanh(c_new)
            if keep:
                tape.append((i, f, o, u, c, tc, h))
            c, h = c_new, o * tc
            hs[:, :, t] = h
        both = np.concatenate([hs[0], np.take_along_axis(hs[1], at[..., None], axis=1)], axis=2)
        return both @ p["out"] + p["ob"], (x, both, tape, at)

    def _backward(self, ids, cache, d_score):
        p, (x, both, tape, at) = self.p, cache
        n, width = ids.shape
        grad = {"out": np.einsum("btk,bty->ky", both, d_score), "ob": d_score.sum(axis=(0, 1))}
        d_both = d_score @ p["out"].T
        d_hs = np.stack([d_both[..., :HIDDEN], np.zeros_like(d_both[..., HIDDEN:])])
        np.put_along_axis(d_hs[1], at[..., None], d_both[..., HIDDEN:], axis=1)
        d_g = np.empty((2, n, width, 4 * HIDDEN), x.dtype)
        grad["wh"] = np.zeros_like(p["wh"])
        dh, dc = np.zeros((2, n, HIDDEN), x.dtype), np.zeros((2, n, HIDDEN), x.dtype)
        wh_t = p["wh"].transpose(0, 2, 1)
        for t in range(width - 1, -1, -1):
            i, f, o, u, c_old, tc, h_old = tape[t]
            dh = dh + d_hs[:, :, t]
            dc = dc + dh * o * (1 - tc * tc)
            g = np.concatenate([dc * u * i * (1 - i), dc * c_old * f * (1 - f), dh * tc * o * (1 - o),
                                dc * i * (1 - u * u)], axis=2)
            d_g[:, :, t] = g
            grad["wh"] += np.matmul(h_old.transpose(0, 2, 1), g)
            dh, dc = np.matmul(g, wh_t), dc * f
        flat = d_g.reshape(2, -1, 4 * HIDDEN)
        grad["wx"] = np.matmul(x.reshape(2, -1, EMBED).transpose(0, 2, 1), flat)
        grad["b"] = flat.sum(axis=1, keepdims=True)
        d_x = np.matmul(flat, p["wx"].transpose(0, 2, 1)).reshape(x.shape)
        d_e = d_x[0] + np.take_along_axis(d_x[1], at[..., None], axis=1)
        grad["emb"] = np.zeros_like(p["emb"])
        np.add.at(grad["emb"], ids, d_e)
        return grad

    # -- CRF ---------------------------------------------------------------
    def _posterior(self, score, length, with_moves=True):
        """Tag marginals (B T Y) and expected transitions (Y Y)."""
        n, width, y = score.shape
        move = (self.p["trans"] + self.allowed).astype(score.dtype)
        live = np.arange(width)[None] < length[:, None]
        a, b = np.empty_like(score), np.zeros_like(score)
        a[:, 0] = score[:, 0] + self.first
        for t in range(1, width):
            new = score[:, t] + _lse(a[:, t - 1, :, None] + move, 1)
            a[:, t] = np.where(live[:, t, None], new, a[:, t - 1])
        for t in range(width - 2, -1, -1):
            new = _lse(move + (score[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(live[:, t + 1, None], new, 0.0)
        z = _lse(a[:, -1], 1)
        m = np.exp(np.minimum(a + b - z[:, None, None], 0.0)) * live[..., None]
        if not with_moves:
            return m, None
        pair = np.exp(np.minimum(a[:, :-1, :, None] + move + (score[:, 1:] + b[:, 1:])[:, :, None, :]
                                 - z[:, None, None, None], 0.0)) * live[:, 1:, None, None]
        return m, pair.sum(axis=(0, 1))

    def _viterbi(self, score, length):
        n, width, y = score.shape
        move = self.p["trans"] + self.allowed
        best = score[:, 0] + self.first
        came = np.zeros((n, width, y), np.int8)
        for t in range(1, width):
            via = best[:, :, None] + move
            new = via.max(axis=1) + score[:, t]
            on = (t < length)[:, None]
            came[:, t] = np.where(on, via.argmax(axis=1), np.arange(y))
            best = np.where(on, new, best)
        path = np.empty((n, width), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(width - 1, 0, -1):
            path[:, t - 1] = came[np.arange(n), t, path[:, t]]
        return path

    # -- use ---------------------------------------------------------------
    @staticmethod
    def pack(texts: list[str]):
        length = np.array([len(t) for t in texts])
        ids = np.zeros((len(texts), int(length.max())), np.int64)
        for i, t in enumerate(texts):
            ids[i, :len(t)] = char_ids(t)
        return ids, length

    def train(self, texts: list[str], spans: list[list[tuple[int, int, int]]], steps: int, batch: int = 64,
              rate: float = 0.01, seed: int = 7, held=None) -> None:
        """``spans``: (kind index, start, end) of each text. Adam on the exact CRF gradient,
        in single precision, with a rate that falls to a tenth. With ``held`` (texts, spans)
        training ends once ``ENOUGH`` of its texts are read without fault, and the
        parameters that read most of them right are kept."""
        rng = np.random.default_rng(seed)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        best, kept = -1.0, self.p
        lengths = np.array([len(t) for t in texts])
        for step in range(1, steps + 1):
            # a batch holds texts of about the same length, since it is as wide as its longest
            pick = rng.integers(0, len(texts), 4 * batch)
            pick = pick[np.argsort(lengths[pick], kind="stable")].reshape(4, batch)[rng.integers(4)]
            ids, length = self.pack([texts[i] for i in pick])
            gold = np.zeros(ids.shape, np.int64)
            for row, i in enumerate(pick):
                for kind, s, e in spans[i]:
                    gold[row, s:e] = 2 + 2 * kind
                    gold[row, s] = 1 + 2 * kind
            score, cache = self._forward(ids, length, keep=True)
            live = np.arange(ids.shape[1])[None] < length[:, None]
            marginal, moved = self._posterior(score, length)
            d_score = ((marginal - np.eye(self.n_tags)[gold] * live[..., None]) / batch).astype(score.dtype)
            grad = self._backward(ids, cache, d_score)
            seen = np.zeros_like(moved)
            np.add.at(seen, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
            grad["trans"] = (moved - seen) / batch
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * (0.1 + 0.9 * (1 - step / steps))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - np.float32(now) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
            if held and held[0] and (step % 100 == 0 or step == steps):
                right = self.accuracy(*held)
                if right > best:
                    best, kept = right, dict(self.p)
                if right >= ENOUGH:
                    break
        if best >= 0:
            self.p = kept

    def accuracy(self, texts: list[str], spans: list[list[tuple[int, int, int]]]) -> float:
        """Share of the texts whose spans are decoded exactly, none more and none less."""
        got = self.decode(texts)
        return sum({x[:3] for x in g} == set(want) for g, want in zip(got, spans)) / len(texts)

    def decode(self, texts: list[str], batch: int = 256) -> list[list[tuple[int, int, int, float]]]:
        """(kind index, start, end, sum of the posteriors of its characters) per text."""
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for at in range(0, len(order), batch):
            group = order[at:at + batch]
            ids, length = self.pack([texts[i] for i in group])
            score, _ = self._forward(ids, length)
            marginal, _ = self._posterior(score, length, with_moves=False)
            path = self._viterbi(score, length)
            for row, i in enumerate(group):
                tags = path[row, :length[row]]
                begins = np.flatnonzero(tags % 2 == 1)
                for s in begins:
                    e = s + 1
                    while e < len(tags) and tags[e] == tags[s] + 1:
                        e += 1
                    weight = float(marginal[row, np.arange(s, e), tags[s:e]].sum())
                    out[i].append((int(tags[s] - 1) // 2, int(s), int(e), weight))
        return out
