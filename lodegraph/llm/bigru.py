"""A bidirectional gated recurrent network over bytes, in numpy: training by backpropagation through time, and inference.

A text is read in windows of `width` bytes (its last one padded). Both directions run over a window from a zero state;
every position gets a distribution over labels from the states of both directions there.
"""

from __future__ import annotations

import numpy as np

PAD = 256


class BiGRU:
    def __init__(self, labels: list[str], hidden: int = 8, width: int = 128, seed: int = 7):
        g = np.random.default_rng(seed)
        h, c = hidden, len(labels)
        self.labels, self.hidden, self.width = labels, hidden, width
        f = lambda *s, k=1.0: (g.standard_normal(s) * k).astype(np.float32)
        # x: input table of each direction and gate (update, reset, candidate); u: recurrent weights; v, c: output
        self.p = {"x": f(2, 3 * h, 257, k=0.4), "u": f(2, 3 * h, h, k=0.5 / np.sqrt(h)), "v": f(c, 2 * h, k=0.3), "c": np.zeros((c, 1), np.float32)}

    # -- forward

    def states(self, idx: np.ndarray, keep: bool = False):
        """idx: (T, B) bytes or PAD. States (T, 2, H, B) by position, and what backpropagation needs."""
        t_max, b = idx.shape
        h, x, u = self.hidden, self.p["x"], self.p["u"]
        # a sigmoid is a tanh of half its input
        half = np.ones((1, 3 * h, 1), np.float32)
        half[:, : 2 * h] = 0.5
        x, u = x * half, u * half
        out = np.empty((t_max, 2, h, b), np.float32)
        gates, rec = np.empty((2, 3 * h, b), np.float32), np.empty((2, 3 * h, b), np.float32)
        state, tape = np.zeros((2, h, b), np.float32), []
        for t in range(t_max):
            np.take(x[0], idx[t], axis=1, out=gates[0], mode="clip")
            np.take(x[1], idx[t_max - 1 - t], axis=1, out=gates[1], mode="clip")
            np.matmul(u, state, out=rec)
            zr = gates[:, : 2 * h]
            zr += rec[:, : 2 * h]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :h], zr[:, h:]
            n = gates[:, 2 * h :]
            n += r * rec[:, 2 * h :]
            np.tanh(n, out=n)
            if keep:
                tape.append((z.copy(), r.copy(), n.copy(), rec[:, 2 * h :].copy(), state))
            state = n + z * (state - n)
            out[t, 0] = state[0]
            out[t_max - 1 - t, 1] = state[1]
        return out, tape

    def probabilities(self, idx: np.ndarray) -> np.ndarray:
        """(T, C, B): every position's distribution."""
        s, _ = self.states(idx)
        t, _, h, b = s.shape
        e = np.matmul(self.p["v"], s.reshape(t, 2 * h, b))
        e += self.p["c"]
        e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(axis=1, keepdims=True)
        return e

    # -- training

    def gradients(self, idx: np.ndarray, want: np.ndarray):
        h, (t_max, b) = self.hidden, idx.shape
        s, tape = self.states(idx, keep=True)
        flat = s.reshape(t_max, 2 * h, b)
        e = np.matmul(self.p["v"], flat) + self.p["c"]
        e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(axis=1, keepdims=True)
        real = (idx != PAD).astype(np.float32)
        total = max(real.sum(), 1)
        loss = -(np.log(np.maximum(e[:, want, np.arange(b)], 1e-9)) * real).sum() / total
        e[:, want, np.arange(b)] -= 1
        e *= real[:, None] / total
        grads = {"v": np.einsum("tcb,thb->ch", e, flat, optimize=True), "c": e.sum(axis=(0, 2))[:, None]}
        ds = np.matmul(self.p["v"].T, e).reshape(t_max, 2, h, b)
        gx, gu = np.zeros_like(self.p["x"]), np.zeros_like(self.p["u"])
        carry = np.zeros((2, h, b), np.float32)
        un = self.p["u"].transpose(0, 2, 1)
        for t in reversed(range(t_max)):
            z, r, n, rn, prev = tape[t]
            d = carry + np.stack([ds[t, 0], ds[t_max - 1 - t, 1]])
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (prev - n) * z * (1 - z)
            dr = dn * rn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            back = np.concatenate([dz, dr, dn * r], axis=1)
            gu += np.matmul(back, prev.transpose(0, 2, 1))
            carry = d * z + np.matmul(un, back)
            for k, row in ((0, idx[t]), (1, idx[t_max - 1 - t])):
                order = np.argsort(row, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], np.diff(row[order]) != 0]))
                gx[k][:, row[order][at]] += np.add.reduceat(da[k][:, order], at, axis=1)
        return loss, grads | {"x": gx, "u": gu}

    def fit(self, idx: np.ndarray, want: np.ndarray, updates: int = 220, batch: int = 192, rate: float = 0.025, seed: int = 11) -> list[float]:
        """Adam over balanced batches; one window in six is cut short, so that short texts are learned, too."""
        g, m, v, losses = np.random.default_rng(seed), {}, {}, []
        by = [np.flatnonzero(want == c) for c in range(len(self.labels))]
        place = np.arange(self.width)[:, None]
        for k in range(1, updates + 1):
            pick = np.array([by[c][g.integers(len(by[c]))] for c in g.integers(len(by), size=batch)])
            size = np.where(g.random(batch) < 1 / 6, g.integers(6, self.width, batch), self.width)
            loss, grads = self.gradients(np.where(place < size, idx[:, pick], PAD), want[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in grads.values()))
            step = rate * (1 - 0.9 * k / updates)
            for name, x in grads.items():
                x = x * min(1.0, 1.0 / max(norm, 1e-9))
                m[name] = 0.9 * m.get(name, 0) + 0.1 * x
                v[name] = 0.99 * v.get(name, 0) + 0.01 * x * x
                self.p[name] -= (step * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
            losses.append(float(loss))
        return losses

    # -- texts

    def windows(self, texts: list[bytes]) -> np.ndarray:
        """(T, B): the first window of each text."""
        idx = np.full((self.width, len(texts)), PAD, np.int64)
        for i, t in enumerate(texts):
            a = np.frombuffer(t[: self.width], np.uint8)
            idx[: len(a), i] = a
        return idx

    def pooled(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chunk: int = 1024, each=None) -> np.ndarray:
        """Mean distribution over all positions of each text data[start : start + size]. each(doc, at, n, probabilities) sees every window."""
        w, n_labels = self.width, len(self.labels)
        count = -(-sizes // w)
        doc = np.repeat(np.arange(len(sizes)), count)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = starts[doc] + within * w
        have = np.minimum(sizes[doc] - within * w, w)
        total = np.zeros((len(sizes), n_labels))
        step = np.arange(w)[:, None]
        for i in range(0, len(doc), chunk):
            a, n, d = at[i : i + chunk], have[i : i + chunk], doc[i : i + chunk]
            place = a + step
            np.minimum(place, len(data) - 1, out=place)
            idx = data[place].astype(np.int64)
            short = n < w
            if short.any():
                idx[step >= n] = PAD
            p = self.probabilities(idx)
            if short.any():
                p *= (step < n)[:, None]
            if each:
                for j in range(len(d)):
                    each(int(d[j]), int(within[i + j]) * w, int(n[j]), p[: n[j], :, j])
            sums = p.sum(axis=0)
            for c in range(n_labels):
                total[:, c] += np.bincount(d, sums[c], len(sizes))
        return total / np.maximum(sizes, 1)[:, None]
