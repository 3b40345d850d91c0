"""Small per-key states shared by batch and streaming forms."""

from __future__ import annotations

import math

import numpy as np

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


class RunLengths:
    """Run-length posterior with at most ceil(5 / hazard) lengths."""

    def __init__(self, hazard: float):
        self.h = min(max(hazard, 1e-6), 1 - 1e-6)
        self.cap = max(1, math.ceil(5.0 / self.h))
        self.log_r = np.array([0.0])
        self.mu, self.kappa = np.array([0.0]), np.array([1.0])
        self.alpha, self.beta = np.array([1.0]), np.array([1.0])

    def step(self, x: float) -> float:
        nu = 2 * self.alpha
        scale = np.maximum(self.beta * (self.kappa + 1) / (self.alpha * self.kappa), 1e-8)
        dev = x - self.mu
        pred = (_LGAMMA((nu + 1) / 2) - _LGAMMA(nu / 2) - 0.5 * np.log(nu * math.pi * scale)
                - (nu + 1) / 2 * np.log1p(dev * dev / (nu * scale)))
        joint = self.log_r + pred
        top = joint.max()
        reset = top + math.log(np.exp(joint - top).sum()) + math.log(self.h)
        keep = min(len(joint), self.cap)
        log_r = np.concatenate([[reset], joint[:keep] + math.log1p(-self.h)])
        top = log_r.max()
        self.log_r = log_r - (top + math.log(np.exp(log_r - top).sum()))
        k, m, d = self.kappa[:keep], self.mu[:keep], dev[:keep]
        self.beta = np.concatenate([[1.0], self.beta[:keep] + k * d * d / (2 * (k + 1))])
        self.mu = np.concatenate([[0.0], (k * m + x) / (k + 1)])
        self.kappa = np.concatenate([[1.0], k + 1])
        self.alpha = np.concatenate([[1.0], self.alpha[:keep] + 0.5])
        return math.exp(self.log_r[0])

    def dump(self) -> list[list[float]]:
        return [a.tolist() for a in (self.log_r, self.mu, self.kappa, self.alpha, self.beta)]

    def load(self, parts) -> "RunLengths":
        self.log_r, self.mu, self.kappa, self.alpha, self.beta = (np.array(p, dtype=float) for p in parts)
        return self
