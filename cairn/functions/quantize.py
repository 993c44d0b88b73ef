"""Vector codes: scalar quantizers, product quantization, and rotated multi-bit codes (RaBitQ), in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cairn.errors import invalid


def scalar_codes(x: np.ndarray, kind: str) -> np.ndarray:
    """The values that a row keeps in fp16, int8 or int4 (both with the row's largest magnitude as scale)."""
    if kind == "fp16":
        return x.astype(np.float16).astype(np.float64)
    most = {"int8": 127, "int4": 7}.get(kind)
    if most is None:
        raise invalid(f"unknown quantizer {kind!r}")
    scale = np.abs(x).max(axis=1, keepdims=True) / most
    return np.round(x / np.where(scale == 0, 1, scale)) * scale


def metric_scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows against one query, higher is better."""
    dots = x @ q
    if metric == "l2":
        return 2 * dots - (x * x).sum(1) - q @ q
    if metric == "cosine":
        norms = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
        return np.divide(dots, norms, out=np.zeros_like(dots), where=norms != 0)
    return dots


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k rows, each the farthest from those chosen before; the first is the one nearest the mean."""
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The squared distances to all centers."""
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)


def kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds from farthest-first seeds; an empty cluster keeps its center."""
    centers = farthest_first(x, k)
    for _ in range(rounds):
        at = nearest(x, centers).argmin(1)
        sums, counts = np.zeros_like(centers), np.bincount(at, minlength=len(centers))
        np.add.at(sums, at, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


@dataclass(frozen=True)
class ProductQuantizer:
    """Codebooks of balanced chunks of dimensions, 256 centers at most in each."""

    edges: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def train(cls, x: np.ndarray, chunks: int, rounds: int = 8) -> ProductQuantizer:
        if not 1 <= chunks <= x.shape[1]:
            raise invalid("chunks must be between 1 and the dimension")
        edges = np.linspace(0, x.shape[1], chunks + 1).round().astype(int)
        return cls(edges, [kmeans(x[:, a:b], min(256, len(x)), rounds) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(x[:, a:b], book).argmin(1) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)], 1).astype(np.int16)

    def scores(self, codes: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
        """Asymmetric scores: sums of per-chunk table entries."""
        parts = [(book, q[a:b], codes[:, i]) for i, (a, b, book) in enumerate(zip(self.edges[:-1], self.edges[1:], self.books, strict=True))]
        dots = sum((book @ piece)[code] for book, piece, code in parts)
        if metric in ("ip", "mips_l2"):
            return dots
        norms = sum((book * book).sum(1)[code] for book, _, code in parts)
        if metric == "l2":
            return 2 * dots - norms - q @ q
        return dots / np.maximum(np.sqrt(norms) * np.linalg.norm(q), 1e-30)


class Rotation:
    """A seeded orthogonal rotation of zero-padded vectors: four rounds of random signs and Hadamard."""

    def __init__(self, dimension: int, seed: int = 7) -> None:
        self.size = 1 << max(0, dimension - 1).bit_length()
        self._signs = np.random.default_rng(seed).choice([-1.0, 1.0], (4, self.size))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.size))
        out[:, : x.shape[1]] = x
        for signs in self._signs:
            out = out * signs
            step = 1
            while step < self.size:
                pairs = out.reshape(len(out), -1, 2, step)
                out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(len(out), self.size)
                step *= 2
            out /= np.sqrt(self.size)
        return out


class RaBitQ:
    """Codes of 1 to 9 bits per rotated coordinate of the residual to a center, with the factor that
    makes the estimated inner product unbiased."""

    def __init__(self, center: np.ndarray, bits: int) -> None:
        if not 1 <= bits <= 9:
            raise invalid("bits must be 1 to 9")
        self.center, self.bits, self.turn = center, bits, Rotation(len(center))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, factors): each row's residual is about factor * (code - middle) after rotation."""
        r = self.turn(x - self.center)
        levels, middle = 1 << self.bits, ((1 << self.bits) - 1) / 2
        width = np.abs(r).max(1, keepdims=True) / max(middle, 0.5)
        codes = np.clip(np.floor(r / np.where(width == 0, 1, width) + middle + 0.5), 0, levels - 1)
        centered = codes - middle
        match = (r * centered).sum(1)
        factors = np.divide((r * r).sum(1), match, out=np.zeros(len(x)), where=match != 0)
        return codes.astype(np.int16), factors

    def scores(self, codes: np.ndarray, factors: np.ndarray, norms: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
        """Estimated scores; ``norms`` are the rows' squared lengths."""
        middle = ((1 << self.bits) - 1) / 2
        dots = factors * ((codes - middle) @ self.turn(q[None])[0]) + self.center @ q
        if metric == "l2":
            return 2 * dots - norms - q @ q
        return dots / np.maximum(np.sqrt(norms) * np.linalg.norm(q), 1e-30) if metric == "cosine" else dots
