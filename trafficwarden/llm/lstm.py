"""A small bidirectional LSTM in numpy, with training by back-propagation through time, and Adam.

Time comes first in all arrays: inputs are (steps, batch, 4 * hidden) pre-activations, one set for
each direction; the caller owns the layer that makes them.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new_params(hidden: int, rng: np.random.Generator) -> Params:
    out = {}
    for way in ("ahead", "back"):
        out[f"{way}_w"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1  # remember at first
        out[f"{way}_b"] = bias
    return out


def _run(z: np.ndarray, mask: np.ndarray | None, w: np.ndarray, b: np.ndarray, keep: bool):
    steps, batch, four = z.shape
    n = four // 4
    h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    out, kept = np.empty((steps, batch, n), np.float32), []
    for t in range(steps):
        a = z[t] + h @ w + b
        gate = sigmoid(a[:, : 3 * n])
        i, f, o = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :]
        g = np.tanh(a[:, 3 * n :])
        before, h0 = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        if mask is not None:
            h, c = h * mask[t][:, None], c * mask[t][:, None]
        out[t] = h
        if keep:
            kept.append((i, f, o, g, before, tc, h0))
    return out, kept


def _grad(dout: np.ndarray, mask: np.ndarray | None, kept: list, w: np.ndarray):
    steps, batch, n = dout.shape
    dz = np.empty((steps, batch, 4 * n), np.float32)
    dw = np.zeros_like(w)
    dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, tc, h0 = kept[t]
        dh = dh + dout[t]
        if mask is not None:
            dh, dc = dh * mask[t][:, None], dc * mask[t][:, None]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw += h0.T @ dz[t]
        dh = dz[t] @ w.T
        dc = dc * f
    return dz, dw


def forward(p: Params, ahead: np.ndarray, back: np.ndarray, mask: np.ndarray | None = None, keep: bool = False):
    """Hidden states (steps, batch, 2 * hidden); what backward() needs, if kept. mask: 1 within a sequence, 0 after it."""
    turned = None if mask is None else mask[::-1]
    one, kept_one = _run(ahead, mask, p["ahead_w"], p["ahead_b"], keep)
    two, kept_two = _run(back[::-1], turned, p["back_w"], p["back_b"], keep)
    return np.concatenate([one, two[::-1]], axis=2), (kept_one, kept_two)


def backward(p: Params, dstates: np.ndarray, kept, mask: np.ndarray | None = None):
    """Gradients of the parameters, and of the inputs of both directions."""
    n = dstates.shape[2] // 2
    turned = None if mask is None else mask[::-1]
    dz_one, dw_one = _grad(dstates[:, :, :n], mask, kept[0], p["ahead_w"])
    dz_two, dw_two = _grad(dstates[::-1, :, n:], turned, kept[1], p["back_w"])
    grads = {"ahead_w": dw_one, "ahead_b": dz_one.sum((0, 1)), "back_w": dw_two, "back_b": dz_two.sum((0, 1))}
    return grads, dz_one, dz_two[::-1]


class Adam:
    """Adam with clipped gradients."""

    def __init__(self, params: Params, rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: Params) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
            self.square[k] = 0.999 * self.square[k] + 0.001 * g * g
            mean, square = self.mean[k] / (1 - 0.9**self.step), self.square[k] / (1 - 0.999**self.step)
            self.params[k] -= (self.rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
