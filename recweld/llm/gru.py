"""A bidirectional gated recurrent network over bytes, in numpy, trained by backpropagation through time.

Both directions are held in one array (axis 0) and step together. Gates are (reset, update, candidate); the two gates use
tanh of half their argument, which is the logistic function up to scale. Every position of a window is labelled from the
two states there.
"""

from __future__ import annotations

import numpy as np

PAD = 0


class ByteGru:
    """hidden: units per direction; classes: number of labels. Weights are float32."""

    def __init__(self, hidden: int, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.hidden, self.classes = hidden, classes
        self.w = {
            "x": (rng.standard_normal((2, 256, 3 * hidden)) * 0.3).astype(f),
            "u": (rng.standard_normal((2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "c": np.zeros((2, 1, hidden), f),  # bias of the recurrent part of the candidate
            "v": (rng.standard_normal((2 * hidden, classes)) * 0.1).astype(f),
            "b": np.zeros(classes, f),
        }

    def _states(self, windows: np.ndarray, keep: bool):
        """windows: length x count of bytes. States, length x 2 x count x hidden, in reading order of each direction."""
        length, count = windows.shape
        n = self.hidden
        w = self.w
        h = np.zeros((2, count, n), np.float32)
        states = np.empty((length, 2, count, n), np.float32)
        kept = []
        a = np.empty((2, count, 3 * n), np.float32)
        x = np.empty((2, count, 3 * n), np.float32)
        for t in range(length):
            np.take(w["x"][0], windows[t], axis=0, out=x[0], mode="clip")
            np.take(w["x"][1], windows[length - 1 - t], axis=0, out=x[1], mode="clip")
            np.matmul(h, w["u"], out=a)
            gates = a[:, :, : 2 * n] + x[:, :, : 2 * n]
            np.tanh(gates * np.float32(0.5), out=gates)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            r, z = gates[:, :, :n], gates[:, :, n:]
            inner = a[:, :, 2 * n :] + w["c"]
            s = np.tanh(x[:, :, 2 * n :] + r * inner)
            if keep:
                kept.append((h, r, z, s, inner))
            h = s + z * (h - s)
            states[t] = h
        return states, kept

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Class probabilities at every position: length x count x classes. windows: length x count.

        The steps of _states() in buffers that are used again, with the gates' factors of a half taken into the weights.
        """
        length, count = windows.shape
        n, w, half = self.hidden, self.w, np.float32(0.5)
        scale = np.concatenate([np.full(2 * n, half), np.ones(n, np.float32)])
        wx, wu = w["x"] * scale, w["u"] * scale
        at = windows.astype(np.intp)
        out = np.empty((2, length, count, self.classes), np.float32)
        h = np.zeros((2, count, n), np.float32)
        a, x = np.empty((2, count, 3 * n), np.float32), np.empty((2, count, 3 * n), np.float32)
        gates, inner = np.empty((2, count, 2 * n), np.float32), np.empty((2, count, n), np.float32)
        for t in range(length):
            back = length - 1 - t
            np.take(wx[0], at[t], axis=0, out=x[0], mode="clip")
            np.take(wx[1], at[back], axis=0, out=x[1], mode="clip")
            np.matmul(h, wu, out=a)
            np.add(a[:, :, : 2 * n], x[:, :, : 2 * n], out=gates)
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            np.add(a[:, :, 2 * n :], w["c"], out=inner)
            inner *= gates[:, :, :n]
            inner += x[:, :, 2 * n :]
            np.tanh(inner, out=inner)
            h -= inner
            h *= gates[:, :, n:]
            h += inner
            np.matmul(h[0], w["v"][:n], out=out[0, t])
            np.matmul(h[1], w["v"][n:], out=out[1, back])
        p = out[0]
        p += out[1]
        p += w["b"]
        np.clip(p, -60, 60, out=p)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p

    def gradients(self, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradients. labels: one per window; weight: length x count."""
        length, count = windows.shape
        n, w = self.hidden, self.w
        states, kept = self._states(windows, True)
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        logits = both @ w["v"] + w["b"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        total = max(float(weight.sum()), 1.0)
        loss = float(-(np.log(p[:, np.arange(count), labels] + 1e-12) * weight).sum() / total)
        d = p
        d[:, np.arange(count), labels] -= 1
        d *= (weight / total)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        flat = d.reshape(-1, self.classes)
        g["v"], g["b"] = both.reshape(-1, 2 * n).T @ flat, flat.sum(axis=0)
        up = d @ w["v"].T
        outer = np.stack([up[:, :, :n], up[::-1, :, n:]], axis=1)
        dh = np.zeros((2, count, n), np.float32)
        for t in range(length - 1, -1, -1):
            h, r, z, s, inner = kept[t]
            dh = dh + outer[t]
            ds = dh * (1 - z) * (1 - s * s)
            dz = dh * (h - s) * z * (1 - z)
            dr = ds * inner * r * (1 - r)
            da = np.concatenate([dr, dz, ds * r], axis=2)
            dx = np.concatenate([dr, dz, ds], axis=2)
            g["u"] += np.swapaxes(h, 1, 2) @ da
            g["c"] += (ds * r).sum(axis=1, keepdims=True)
            np.add.at(g["x"][0], windows[t], dx[0])
            np.add.at(g["x"][1], windows[length - 1 - t], dx[1])
            dh = dh * z + da @ np.swapaxes(w["u"], 1, 2)
        return loss, g

    def train(self, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray, steps: int, batch: int, rate: float = 0.02, seed: int = 1, share: np.ndarray | None = None) -> list[float]:
        """Adam with a rate that falls to zero and clipped gradients; returns the losses. share: how often each window is drawn."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        cumulative = np.cumsum(share) if share is not None else None
        for step in range(1, steps + 1):
            at = rng.integers(0, windows.shape[1], batch) if cumulative is None else np.minimum(np.searchsorted(cumulative, rng.random(batch) * cumulative[-1]), windows.shape[1] - 1)
            loss, g = self.gradients(windows[:, at], labels[at], weight[:, at])
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            scale = min(1.0, 1.0 / (norm + 1e-12))
            now = rate * (1 - (step - 1) / steps)
            for k, x in g.items():
                x = x * np.float32(scale)
                m[k] += np.float32(0.1) * (x - m[k])
                s[k] += np.float32(0.01) * (x * x - s[k])
                self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses
