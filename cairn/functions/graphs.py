"""Proximity graphs over one shard of vectors: layered (HNSW) and flat pruned (Vamana), in numpy."""

from __future__ import annotations

import heapq

import numpy as np

from cairn.functions.quantize import metric_scores

_MIX = 0x9E3779B97F4A7C15
#: Nodes whose distances to all others are held at once.
BLOCK = 256


def level_of(i: int, m: int) -> int:
    """A node's top layer, from a hash of its place: geometric with ratio 1/m."""
    x = ((i + 1) * _MIX) & ((1 << 64) - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
    u = ((x ^ (x >> 31)) + 1) / 2.0**64
    return int(-np.log(min(u, 1.0)) / np.log(max(m, 2)))


def pruned(x: np.ndarray, node: int, found: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Robust pruning: nearest first, leaving out what a kept neighbour is ``alpha`` times closer to."""
    found = found[found != node]
    own = ((x[found] - x[node]) ** 2).sum(1)
    left, own = found[np.argsort(own, kind="stable")], np.sort(own)
    kept: list[int] = []
    while len(left) and len(kept) < degree:
        kept.append(int(left[0]))
        between = ((x[left] - x[left[0]]) ** 2).sum(1)
        stay = alpha * alpha * between > own
        stay[0] = False
        left, own = left[stay], own[stay]
    return kept


def augmented(x: np.ndarray) -> np.ndarray:
    """Rows with one more coordinate that makes their lengths equal: inner product as distance."""
    norms = (x * x).sum(1)
    return np.hstack([x, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0))[:, None]])


class Graph:
    """Layers of neighbour lists; a flat graph has one. Layer 0 holds every node."""

    def __init__(self, layers: list[dict[int, list[int]]], entry: int) -> None:
        self.layers, self.entry = layers, entry

    @classmethod
    def build(cls, x: np.ndarray, metric: str, degree: int, beam: int, layered: bool, alpha: float = 1.0) -> Graph:
        """Neighbours are chosen among each node's ``beam`` exact nearest of its layer and a ring."""
        space = augmented(x) if metric in ("ip", "mips_l2") else x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) if metric == "cosine" else x
        levels = np.array([level_of(i, degree) if layered else 0 for i in range(len(x))])
        layers: list[dict[int, list[int]]] = []
        for level in range(int(levels.max(initial=0)) + 1):
            nodes = np.flatnonzero(levels >= level)
            most = 2 * degree if layered and level == 0 else degree
            links: dict[int, list[int]] = {int(i): [] for i in nodes}
            sub = space[nodes]
            squares = (sub * sub).sum(1)
            for a in range(0, len(nodes), BLOCK):
                far = squares - 2 * sub[a : a + BLOCK] @ sub.T
                k = min(beam + 1, len(nodes))
                near = np.argpartition(far, k - 1, axis=1)[:, :k]
                for i, row in zip(nodes[a : a + BLOCK], near, strict=True):
                    links[int(i)] = pruned(space, int(i), nodes[row], max(1, most - 1), alpha)
            for n, i in enumerate(nodes):  # a ring keeps the layer connected
                after = int(nodes[(n + 1) % len(nodes)])
                if after != i and after not in links[int(i)]:
                    links[int(i)].append(after)
            for i in list(links):  # links lead both ways
                for j in links[i]:
                    if i not in links[j]:
                        links[j].append(i)
            for i, own in links.items():
                if len(own) > 2 * most:
                    ring = [j for j in own if abs(j - i) == 1]
                    links[i] = list(dict.fromkeys(ring + pruned(space, i, np.array(own), 2 * most - len(ring), alpha)))
            layers.append(links)
        top = np.flatnonzero(levels == levels.max(initial=0))
        entry = int(top[((space[top] - space.mean(0)) ** 2).sum(1).argmin()]) if len(x) else 0
        return cls(layers, entry)

    def search(self, x: np.ndarray, q: np.ndarray, metric: str, ef: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        """Up to ``ef`` (score, node), best first. Nodes that are not allowed are passed through, not returned."""
        if not len(x):
            return []
        if ef >= len(x):
            s = metric_scores(x, q, metric)
            return sorted(((float(s[i]), i) for i in range(len(x)) if allowed is None or allowed[i]), key=lambda t: (-t[0], t[1]))
        score = lambda nodes: metric_scores(x[nodes], q, metric)
        at, best = self.entry, float(score([self.entry])[0])
        for links in reversed(self.layers[1:]):
            while near := links[at]:
                s = score(near)
                if s.max() <= best:
                    break
                at, best = near[int(s.argmax())], float(s.max())
        seen, open_ = {at}, [(-best, at)]
        held: list[tuple[float, int]] = [(best, at)]
        out = [(best, at)] if allowed is None or allowed[at] else []
        while open_:
            s, node = heapq.heappop(open_)
            if len(held) >= ef and -s < held[0][0] and (allowed is None or len(out) >= ef):
                break
            new = [j for j in self.layers[0][node] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for value, j in zip(score(new).tolist(), new, strict=True):
                if len(held) < ef or value > held[0][0] or allowed is not None and len(out) < ef:
                    heapq.heappush(open_, (-value, j))
                    heapq.heappush(held, (value, j))
                    if len(held) > ef:
                        heapq.heappop(held)
                    if allowed is None or allowed[j]:
                        out.append((value, j))
        return sorted(out, key=lambda t: (-t[0], t[1]))[:ef]
