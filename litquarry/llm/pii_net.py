"""A character-level bidirectional LSTM with a conditional random field on top, in numpy.

Training runs full back-propagation through time and the exact gradient of the sequence likelihood; inference is batched over
windows, with time as the only Python loop.
"""

from __future__ import annotations

import io
from functools import lru_cache

import numpy as np

TYPES = ["email", "phone", "id_number", "address", "name"]
TAGS = ["O", *[f"{p}-{t}" for t in TYPES for p in "BI"]]
K = len(TAGS)
VOCAB = 512
_TABLE = None


def fold_table() -> np.ndarray:
    """One code point to one: full-width forms and unusual spaces to their plain forms."""
    global _TABLE
    if _TABLE is None:
        t = np.arange(0x110000, dtype=np.uint32)
        t[0xFF01:0xFF5F] = np.arange(0x21, 0x7F)
        for c in (0xA0, 0x3000, 0x202F, 0x205F, *range(0x2000, 0x200B)):
            t[c] = 0x20
        t[0x2010], t[0x2011] = 0x2D, 0x2D
        # Chinese punctuation stays apart from its narrow form, as in running text.
        for c in (0xFF0C, 0xFF1A, 0xFF1B, 0xFF01, 0xFF1F):
            t[c] = c
        _TABLE = t
    return _TABLE


def codes(text: str) -> np.ndarray:
    return fold_table()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]


def fold_text(text: str) -> str:
    return codes(text).astype("<u4").tobytes().decode("utf-32-le")


@lru_cache(maxsize=1)
def char_ids() -> np.ndarray:
    """Code point to one of VOCAB character ids: ASCII as it is, everything else by a fixed hash of the code point."""
    c = np.arange(0x110000, dtype=np.uint64)
    h = (c * np.uint64(2654435761)) >> np.uint64(7)
    return np.where(c < 128, c, 128 + h % np.uint64(VOCAB - 128)).astype(np.int32)


def allowed() -> np.ndarray:
    """Transitions that make sense: an inside tag follows a tag of its own type."""
    ok = np.ones((K, K), dtype=bool)
    for j, b in enumerate(TAGS):
        if b[0] == "I":
            for i, a in enumerate(TAGS):
                ok[i, j] = a[2:] == b[2:] and a != "O"
    return ok


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    def __init__(self, embed: int = 20, hidden: int = 32, seed: int = 5):
        r = np.random.default_rng(seed)
        self.e, self.h = embed, hidden
        u = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": (r.standard_normal((VOCAB, embed)) * 0.3).astype(np.float32), "T": np.zeros((K, K), np.float32), "S": np.zeros(K, np.float32), "Wo": u(2 * hidden, K), "bo": np.zeros(K, np.float32)}
        for d in "fb":
            self.p["W" + d] = u(embed + hidden, 4 * hidden)
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1.0
            self.p["b" + d] = b

    # Gates are in the order input, forget, output, candidate.
    def _run(self, x: np.ndarray, d: str, keep: bool):
        """x: T x B x E. Returns hidden states T x B x H and, for training, what the backward pass needs."""
        steps, batch, _ = x.shape
        w, b, n = self.p["W" + d], self.p["b" + d], self.h
        wx, wh = w[: self.e], w[self.e :]
        gates_x = (x.reshape(-1, self.e) @ wx + b).reshape(steps, batch, 4 * n)
        h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        out = np.empty((steps, batch, n), np.float32)
        saved = []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            z = gates_x[t] + h @ wh
            s = sigmoid(z[:, : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            prev_c, prev_h = c, h
            c = s[:, n : 2 * n] * c + s[:, :n] * g
            tc = np.tanh(c)
            h = s[:, 2 * n :] * tc
            out[t] = h
            if keep:
                saved.append((t, s, g, prev_c, prev_h, tc))
        return out, saved

    def _direction_table(self, d: str) -> np.ndarray:
        """Gate inputs of every character id: embedding and input weights folded into one table for inference."""
        return (self.p["E"] @ self.p["W" + d][: self.e] + self.p["b" + d]).astype(np.float32)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """ids: T x B. Scores T x B x K. Both directions and all gates are one array; the second direction runs from the end."""
        steps, batch = ids.shape
        n = self.h
        w = np.stack([self.p["Wf"][self.e :], self.p["Wb"][self.e :]])
        table_f, table_b = self._direction_table("f"), self._direction_table("b")
        for x in (w, table_f, table_b):
            x[..., : 3 * n] *= 0.5  # of the sigmoid as a tanh
        h, c = np.zeros((2, batch, n), np.float32), np.zeros((2, batch, n), np.float32)
        z, new = np.empty((2, batch, 4 * n), np.float32), np.empty((2, batch, n), np.float32)
        states = np.empty((steps, 2, batch, n), np.float32)
        for t in range(steps):
            np.matmul(h, w, out=z)
            z[0] += table_f[ids[t]]
            z[1] += table_b[ids[steps - 1 - t]]
            np.tanh(z, out=z)
            gates = z[:, :, : 3 * n]
            gates += 1
            gates *= 0.5
            c *= z[:, :, n : 2 * n]
            np.multiply(z[:, :, :n], z[:, :, 3 * n :], out=new)
            c += new
            np.tanh(c, out=new)
            h = np.multiply(z[:, :, 2 * n : 3 * n], new, out=states[t])
        return states[:, 0] @ self.p["Wo"][:n] + states[::-1, 1] @ self.p["Wo"][n:] + self.p["bo"]

    def transitions(self) -> np.ndarray:
        return np.where(allowed(), self.p["T"], -1e4).astype(np.float32)

    def viterbi(self, score: np.ndarray) -> np.ndarray:
        """score: T x B x K. Best tags T x B. The way back takes each maximum again, so no back pointers are stored."""
        steps, batch, _ = score.shape
        tr = np.ascontiguousarray(self.transitions())
        s = np.ascontiguousarray(score.transpose(0, 2, 1))
        best = np.empty((steps, K, batch), np.float32)
        best[0] = s[0] + (self.p["S"] + np.where([t[0] == "I" for t in TAGS], -1e4, 0).astype(np.float32))[:, None]
        from_to = np.empty((K, K, batch), np.float32)
        for t in range(1, steps):
            np.add(best[t - 1][:, None, :], tr[:, :, None], out=from_to)
            from_to.max(axis=0, out=best[t])
            best[t] += s[t]
        tags = np.empty((steps, batch), np.int8)
        tags[-1] = best[-1].argmax(0)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = (best[t - 1] + tr[:, tags[t]]).argmax(0)
        return tags

    def loss_and_grads(self, ids: np.ndarray, gold: np.ndarray):
        """Mean negative log-likelihood of gold tags (T x B) and the gradients of all parameters."""
        p, n = self.p, self.h
        steps, batch = ids.shape
        x = p["E"][ids]
        hf, sf = self._run(x, "f", True)
        hb, sb = self._run(x, "b", True)
        h = np.concatenate([hf, hb], 2)
        score = (h.reshape(-1, 2 * n) @ p["Wo"] + p["bo"]).reshape(steps, batch, K).astype(np.float64)
        tr = np.where(allowed(), p["T"], -1e4).astype(np.float64)
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha = np.empty((steps, batch, K))
        alpha[0] = score[0] + p["S"]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + tr[None], 1) + score[t]
        z = lse(alpha[-1], 1)
        beta = np.zeros((steps, batch, K))
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(tr[None] + (score[t + 1] + beta[t + 1])[:, None, :], 2)
        rows = np.arange(batch)
        good = score[np.arange(steps)[:, None], rows, gold].sum(0) + p["S"][gold[0]] + tr[gold[:-1], gold[1:]].sum(0)
        loss = (z - good).mean()
        post = np.exp(alpha + beta - z[None, :, None])
        dtr = np.zeros((K, K))
        for t in range(1, steps):
            dtr += np.exp(alpha[t - 1][:, :, None] + tr[None] + (score[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dtr, (gold[:-1].ravel(), gold[1:].ravel()), -1)
        ds = post.copy()
        ds[np.arange(steps)[:, None], rows, gold] -= 1
        ds = (ds / batch).astype(np.float32)
        g = {"T": np.where(allowed(), dtr / batch, 0).astype(np.float32)}
        start = post[0].copy()
        start[rows, gold[0]] -= 1
        g["S"] = (start.sum(0) / batch).astype(np.float32)
        flat = ds.reshape(-1, K)
        g["Wo"], g["bo"] = h.reshape(-1, 2 * n).T @ flat, flat.sum(0)
        dh = (flat @ p["Wo"].T).reshape(steps, batch, 2 * n)
        dx = np.zeros_like(x)
        for d, saved, part in (("f", sf, dh[:, :, :n]), ("b", sb, dh[:, :, n:])):
            w = p["W" + d]
            gw, gb = np.zeros_like(w), np.zeros_like(p["b" + d])
            ch, cc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
            for t, s, cand, prev_c, prev_h, tc in reversed(saved):
                i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
                ch = ch + part[t]
                cc = cc + ch * o * (1 - tc * tc)
                dz = np.concatenate([cc * cand * i * (1 - i), cc * prev_c * f * (1 - f), ch * tc * o * (1 - o), cc * i * (1 - cand * cand)], 1)
                gw[: self.e] += x[t].T @ dz
                gw[self.e :] += prev_h.T @ dz
                gb += dz.sum(0)
                dx[t] += dz @ w[: self.e].T
                ch = dz @ w[self.e :].T
                cc = cc * f
            g["W" + d], g["b" + d] = gw, gb
        ge = np.zeros_like(p["E"])
        np.add.at(ge, ids.ravel(), dx.reshape(-1, self.e))
        g["E"] = ge
        return float(loss), g

    def fit(self, ids: np.ndarray, gold: np.ndarray, epochs: int, batch: int = 64, rate: float = 4e-3, seed: int = 1, log=print, deadline=None):
        """ids, gold: N x T. Adam with a falling rate and clipped gradients."""
        import time

        r = np.random.default_rng(seed)
        m, v, k = {a: np.zeros_like(b) for a, b in self.p.items()}, {a: np.zeros_like(b) for a, b in self.p.items()}, 0
        for e in range(epochs):
            order, total = r.permutation(len(ids)), 0.0
            lr = rate * 0.5 * (1 + np.cos(np.pi * e / epochs)) + 1e-4
            for a in range(0, len(order), batch):
                idx = order[a : a + batch]
                loss, g = self.loss_and_grads(ids[idx].T, gold[idx].T)
                total += loss * len(idx)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                k += 1
                for name, x in g.items():
                    x = x * min(1.0, 5.0 / (norm + 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * x
                    v[name] = 0.999 * v[name] + 0.001 * x * x
                    self.p[name] -= (lr * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
            log(f"epoch {e}: loss {total / len(ids):.4f}")
            if deadline and time.time() > deadline:
                break
        return self

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in self.p.items()})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tagger:
        z = np.load(io.BytesIO(data))
        t = cls(z["E"].shape[1], z["Wo"].shape[0] // 2)
        t.p = {k: z[k].astype(np.float32) for k in z.files}
        return t
