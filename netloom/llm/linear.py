"""Linear models on unit-length hashed features, fitted on the driver from a bounded sample."""

from __future__ import annotations

import warnings
import zlib

import numpy as np


def unit(counts: np.ndarray) -> np.ndarray:
    """log(1 + count), scaled to length one; a row of zeros stays."""
    x = np.log1p(counts, dtype=np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


def squeezed(counts: np.ndarray) -> bytes:
    """Counts in single precision, which no text's count overflows; mostly zeros, so they are deflated for the way to the driver."""
    return zlib.compress(counts.astype(np.float32).tobytes(), 1)


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Unit-length feature rows from squeezed counts, made in place: one matrix, no copies beside it."""
    x = np.empty((len(rows), width), np.float32)
    for i, raw in enumerate(rows):
        x[i] = np.frombuffer(zlib.decompress(raw), np.float32)
    np.log1p(x, out=x)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def byte_grams(raw: np.ndarray, bits: int, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Counts of hashed byte n-grams of one text."""
    out = np.zeros(1 << bits, np.float32)
    b = raw.astype(np.uint32)
    for n in orders:
        if len(b) < n:
            break
        h = np.full(len(b) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ b[k : len(b) - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        out += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def fit(x: np.ndarray, y: np.ndarray, loss: str, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias for y in {-1, 1} under squared hinge (a support vector machine) or logistic loss, by accelerated gradient steps."""
    n = len(y)
    w, bias, v, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    rate = 1 / (penalty + (4.0 if loss == "hinge" else 0.5))
    for step in range(steps):
        m = y * (x @ v + vb)
        g = -y * (2 * np.maximum(0, 1 - m) if loss == "hinge" else 1 / (1 + np.exp(np.clip(m, -40, 40)))) / n
        g = g.astype(np.float32)
        new, new_bias = v - rate * (x.T @ g + penalty * v), vb - rate * float(g.sum())
        momentum = step / (step + 3)
        v, vb = new + momentum * (new - w), new_bias + momentum * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Platt's a, b of the probability 1 / (1 + exp(-(a * margin + b))), with his smoothed targets: Newton steps on the convex
    loss, each halved until the loss falls. Margins that are all equal, or higher for the negative rows, can't be scaled
    to a rising probability: they keep a = 1, b = 0, with a warning, as does a fit whose gradient doesn't come near zero."""
    margin, pos, neg = np.asarray(margin, float), float((y > 0).sum()), float((y < 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = float(np.abs(margin).max(initial=0.0)) or 1.0
    m, ridge = margin / spread, 1e-6

    def loss(a: float, b: float) -> float:
        z = a * m + b
        return float((np.logaddexp(0, z) - t * z).sum() + ridge * a * a / 2)

    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    now = loss(a, b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        d, h = p - t, p * (1 - p)
        g = np.array([(d * m).sum() + ridge * a, d.sum()])
        if np.abs(g).max() < 1e-7 * max(1.0, len(m)):
            break
        hessian = np.array([[(h * m * m).sum() + ridge, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-9]])
        step, size = np.linalg.solve(hessian + 1e-12 * np.eye(2), g), 1.0
        while size > 1e-10 and loss(a - size * step[0], b - size * step[1]) > now - 1e-4 * size * float(g @ step):
            size /= 2
        if size <= 1e-10:
            break
        a, b = a - size * step[0], b - size * step[1]
        now = loss(a, b)
    p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
    if max(abs(float(((p - t) * m).sum() + ridge * a)), abs(float((p - t).sum()))) > 1e-3 * max(1.0, len(m)) or a <= 1e-6:
        warnings.warn("margins could not be calibrated; they are used as they are", RuntimeWarning, stacklevel=2)
        return 1.0, 0.0
    return float(a / spread), float(b)


def probability(margin: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
