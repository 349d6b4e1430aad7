"""Dense NumPy version of both solver steps, for parity tests on small tensors only.

Written from the formulas, with dense arrays and no shared code with the package.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-16


def dense(rows, dims, value):
    out = np.zeros(dims)
    for row in rows:
        out[tuple(row[f"i{w}"] for w in range(len(dims)))] = row[value]
    return out


def mttkrp(tensor, mats, way):
    n, letters = tensor.ndim, "abcdefgh"
    spec = letters[:n] + "," + ",".join(letters[w] + "r" for w in range(n) if w != way)
    return np.einsum(f"{spec}->{letters[way]}r", tensor, *[mats[w] for w in range(n) if w != way])


def core(tensor, mats):
    letters = "abcdefgh"
    spec = letters[: tensor.ndim] + "," + ",".join(letters[w] + "r" for w in range(tensor.ndim))
    return np.einsum(f"{spec}->r", tensor, *mats)


def gram_product(mats, skip=None):
    out = 1.0
    for w, m in enumerate(mats):
        if w != skip:
            out = out * (m.T @ m)
    return out


def unit(column):
    n = np.sqrt((column * column).sum())
    return column / n if n > 0 else column


def cost(x, y, u, v):
    def rel(t, mats):
        norm = np.sqrt((t * t).sum())
        err = norm**2 + gram_product(mats).sum() - 2 * core(t, mats).sum()
        return np.sqrt(max(err, 0)) / norm

    return (rel(x, u) + rel(y, v)) / 2


def formula_factor(dim, way, rank, side, seed):
    p, q = 2147483647, 2147483629
    i = np.arange(dim, dtype=np.int64) + 1
    columns = []
    for r in range(rank):
        base = (seed + 1) * 1000003 + (way + 1) * 7919 + (r + 1) * 104729 + side * 15485863
        a, b, c, d, e = [((base + k * 179424673) % p) ** 2 % p * 48271 % p + 1 for k in range(1, 6)]
        h = (i % p * a + i % q * b + c) % p
        columns.append((h * h % p * d + h * e) % p)
    return np.stack(columns, axis=1) / float(p)


def start(dims, rank, seed):
    out = []
    for side in (0, 1):
        mats = [formula_factor(d, w, rank, side, seed) for w, d in enumerate(dims)]
        out.append([np.stack([unit(c) for c in m.T], axis=1) for m in mats])
    return out


class Pairwise:
    def __init__(self, x, y, u, v, lam, ahead=False):
        self.ahead, self.push, self.previous, self.restarts = ahead, 0.0, 1e10, 0
        self.old = [m.copy() for m in u], [m.copy() for m in v]
        self.x, self.y, self.u, self.v, self.lam = x, y, u, v, lam
        self.zx, self.zy = np.maximum(x - y, 0), np.maximum(y - x, 0)
        self.s = None
        rank = u[0].shape[1]
        self.wx = self.wy = self.zwx = self.zwy = np.full(rank, 1 / rank)
        self.momentum = 1.0

    def step(self):
        u, v, (l1, l2, l3) = self.u, self.v, self.lam
        n1, n2 = 1 / np.sqrt((self.x**2).sum()), 1 / np.sqrt((self.y**2).sum())
        ways, rank = len(u), u[0].shape[1]
        for k in range(ways):
            begun = u[k].copy(), v[k].copy()
            pu, pv = (m + self.push * (m - o[k]) for m, o in zip(begun, self.old))
            fx, fy = gram_product(u, k), gram_product(v, k)
            mx, my = mttkrp(self.x, u, k), mttkrp(self.y, v, k)
            mz1, mz2 = mttkrp(self.zx, u, k), mttkrp(self.zy, v, k)
            ms1, ms2 = mttkrp(self.s, u, k), mttkrp(self.s, v, k)
            for l in range(rank):
                a, b = 1 - self.wx[l], 1 - self.wy[l]
                p, q = (u[k] @ fx)[:, l], (v[k] @ fy)[:, l]
                d = a * u[k][:, l] - b * v[k][:, l]
                gu = (p - mx[:, l] + n1 * l1 * self.wx[l] * (self.wx[l] * p - mz1[:, l])
                      + n1 * l2 * a * (a * p - ms1[:, l]) + n1 * l3 * d * a)
                gv = (q - my[:, l] + n2 * l1 * self.wy[l] * (self.wy[l] * q - mz2[:, l])
                      + n2 * l2 * b * (b * q - ms2[:, l]) - n2 * l3 * d * b)
                nu = pu[:, l] - gu / np.linalg.norm(fx)
                nv = pv[:, l] - gv / np.linalg.norm(fy)
                if k < ways - 1:
                    nu, nv = unit(nu), unit(nv)
                u[k][:, l] = np.where(nu < EPS, 0, nu)
                v[k][:, l] = np.where(nv < EPS, 0, nv)
            self.old[0][k], self.old[1][k] = begun
        fx, fy = gram_product(u), gram_product(v)
        uu = sum((m * m).sum(0) for m in u)
        vv = sum((m * m).sum(0) for m in v)
        uv = sum((m * o).sum(0) for m, o in zip(u, v))
        a, b = 1 - self.wx, 1 - self.wy
        dx = (l1 * (self.wx * np.diag(fx) - core(self.zx, u))
              - l2 * (a * np.diag(fx) - core(self.s, u)) - l3 * (a * uu - b * uv))
        dy = (l1 * (self.wy * np.diag(fy) - core(self.zy, v))
              - l2 * (b * np.diag(fy) - core(self.s, v)) + l3 * (a * uv - b * vv))
        rx, ry = self.zwx - dx / np.linalg.norm(fx), self.zwy - dy / np.linalg.norm(fy)
        rx, ry = np.where(rx < EPS, 0, rx), np.where(ry < EPS, 0, ry)
        rx, ry = rx / rx.sum(), ry / ry.sum()
        following = (1 + np.sqrt(4 * self.momentum**2 + 1)) / 2
        c = (self.momentum - 1) / following
        self.zwx, self.zwy = rx + c * (rx - self.wx), ry + c * (ry - self.wy)
        self.wx, self.wy, self.momentum = rx, ry, following
        now = cost(self.x, self.y, u, v)
        if self.ahead:
            self.push = c
            if now > self.previous:
                self.restarts, self.momentum, self.push, self.zwx, self.zwy = self.restarts + 1, 1.0, 0.0, rx, ry
        self.previous = now
        return now


def baseline_step(x, y, u, v, k, alpha, beta):
    n1, n2 = np.sqrt((x**2).sum()), np.sqrt((y**2).sum())
    ways, rank = len(u), u[0].shape[1]
    fx = [gram_product(u, w) for w in range(ways)]
    fy = [gram_product(v, w) for w in range(ways)]
    mx = [mttkrp(x, u, w) for w in range(ways)]
    my = [mttkrp(y, v, w) for w in range(ways)]
    ud = [m[:, k:].sum(1) for m in u]
    vd = [m[:, k:].sum(1) for m in v]
    u, v = [m.copy() for m in u], [m.copy() for m in v]
    for l in range(rank):
        for w in range(ways):
            f, g = fx[w][l, l], fy[w][l, l]
            if l < k:
                u[w][:, l] = u[w][:, l] * f / (f + n1 * alpha) + (
                    mx[w][:, l] - (u[w] @ fx[w])[:, l] + n1 * alpha * v[w][:, l]
                ) / (f + n1 * alpha + EPS)
                v[w][:, l] = v[w][:, l] * g / (g + n2 * alpha) + (
                    my[w][:, l] - (v[w] @ fy[w])[:, l] + n2 * alpha * u[w][:, l]
                ) / (g + n2 * alpha + EPS)
            else:
                u[w][:, l] += (mx[w][:, l] - (u[w] @ fx[w])[:, l] - n1 * beta / 2 * vd[w]) / (f + EPS)
                v[w][:, l] += (my[w][:, l] - (v[w] @ fy[w])[:, l] + n2 * beta / 2 * ud[w]) / (g + EPS)
            u[w][:, l] = np.maximum(u[w][:, l], EPS)
            v[w][:, l] = np.maximum(v[w][:, l], EPS)
    for w in range(ways - 1):
        u[w] = np.stack([unit(c) for c in u[w].T], axis=1)
        v[w] = np.stack([unit(c) for c in v[w].T], axis=1)
    return u, v, cost(x, y, u, v)
