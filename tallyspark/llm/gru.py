"""A gated recurrent layer in numpy: forward over many sequences at once, and back-propagation through time."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
    """gates: steps x sequences x 3h, what the inputs give to the update, reset and new parts; u: h x 3h; mask: steps x sequences.
    Returns the states after each step, and with `keep` what backward() needs."""
    steps, n, width = gates.shape
    h = width // 3
    states = np.zeros((steps + 1, n, h), np.float32)
    kept = []
    for t in range(steps):
        before = states[t]
        own = before @ u
        zr = sigmoid(gates[t, :, : 2 * h] + own[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(gates[t, :, 2 * h :] + r * own[:, 2 * h :])
        m = mask[t][:, None] * (1 - z)
        states[t + 1] = before + m * (new - before)
        if keep:
            kept.append((z, r, new, own[:, 2 * h :]))
    return (states[1:], (states, kept, u, mask)) if keep else states[1:]


def backward(d_states: np.ndarray, cache) -> tuple[np.ndarray, np.ndarray]:
    """From the gradients of the states after each step, those of the gates and of u."""
    states, kept, u, mask = cache
    steps, n, h = d_states.shape
    d_gates, d_u, carry = np.zeros((steps, n, 3 * h), np.float32), np.zeros_like(u), np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, new, own = kept[t]
        before, m = states[t], mask[t][:, None]
        d = d_states[t] + carry
        d_new = d * m * (1 - z) * (1 - new * new)
        d_z = d * m * (before - new) * z * (1 - z)
        d_r = d_new * own * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
        d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_u += before.T @ d_own
        carry = d * (1 - m * (1 - z)) + d_own @ u.T
    return d_gates, d_u


def run(table: np.ndarray, u: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """forward() for inference: the gates of step t are table[codes[t]], and a row of `table` that holds HOLD in its update part leaves
    a sequence as it is. codes: steps x sequences."""
    h = u.shape[0]
    t_zr, t_new = np.ascontiguousarray(table[:, : 2 * h]) * np.float32(0.5), np.ascontiguousarray(table[:, 2 * h :])
    u_zr, u_new = np.ascontiguousarray(u[:, : 2 * h]) * np.float32(0.5), np.ascontiguousarray(u[:, 2 * h :])
    half = np.float32(0.5)
    state = np.zeros((codes.shape[1], h), np.float32)
    states = np.empty((*codes.shape, h), np.float32)
    for t, code in enumerate(codes):
        zr = t_zr.take(code, axis=0)
        zr += state @ u_zr
        np.tanh(zr, out=zr)
        zr *= half
        zr += half
        new = state @ u_new
        new *= zr[:, h:]
        new += t_new.take(code, axis=0)
        np.tanh(new, out=new)
        new -= state
        np.subtract(1, zr[:, :h], out=zr[:, :h])
        new *= zr[:, :h]
        state = np.add(state, new, out=states[t])
    return states


def add_rows(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of `values` by `index`."""
    flat = values.reshape(index.size, -1)
    return np.stack([np.bincount(index.ravel(), flat[:, k], rows) for k in range(flat.shape[1])], axis=1).astype(np.float32)


#: An update gate of 1.
HOLD = np.float32(60)


def held(table: np.ndarray) -> np.ndarray:
    """A row more, for places where a sequence has ended."""
    row = np.zeros((1, table.shape[1]), np.float32)
    row[0, : table.shape[1] // 3] = HOLD
    return np.concatenate([table.astype(np.float32), row])


class Adam:
    """The Adam update of a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, 5.0 / (norm + 1e-8))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            step = self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
            self.params[k] -= (self.rate * step).astype(np.float32)
