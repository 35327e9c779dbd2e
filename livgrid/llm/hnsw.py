"""A hierarchical navigable small-world graph over unit vectors, in numpy. Deterministic: levels come from the ids' hashes."""

from __future__ import annotations

import heapq
import math

import numpy as np

from livgrid.llm.wordhash import mix

#: Neighbours of a node on the upper levels (twice as many on the lowest), and the beam while building.
NEIGHBOURS, BUILD_BEAM = 12, 48


class Hnsw:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        """vectors: one unit vector a row; ids: what the levels are drawn from."""
        self.x = np.ascontiguousarray(vectors, np.float64)
        n = len(self.x)
        draw = (mix(ids.astype(np.int64).view(np.uint64), 61) >> np.uint64(11)).astype(np.float64) / 2.0**53
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-18)) / math.log(NEIGHBOURS)).astype(int), 12)
        self.links: list[list[np.ndarray]] = [[np.zeros(0, np.int64) for _ in range(k + 1)] for k in self.level]
        self.stamp, self.now = np.zeros(n, np.int64), 0
        self.entry = 0
        for i in range(1, n):
            self._insert(i)

    @classmethod
    def of(cls, vectors: np.ndarray, links: list[list[np.ndarray]]) -> Hnsw:
        """A graph that was built before: the vectors, and each one's neighbours by level."""
        out = cls.__new__(cls)
        out.x = np.ascontiguousarray(vectors, np.float64)
        out.links = links
        out.level = np.array([len(x) - 1 for x in links], int)
        out.stamp, out.now = np.zeros(len(out.x), np.int64), 0
        out.entry = int(out.level.argmax())  # any node of the highest level does
        return out

    def _layer(self, q: np.ndarray, starts: list[tuple[float, int]], beam: int, level: int) -> list[tuple[float, int]]:
        """The beam's (similarity, node), best first."""
        self.now += 1
        stamp, now, x, links = self.stamp, self.now, self.x, self.links
        for _, i in starts:
            stamp[i] = now
        open_ = [(-s, i) for s, i in starts]
        heapq.heapify(open_)
        best = list(starts)
        heapq.heapify(best)
        pop, push, replace = heapq.heappop, heapq.heappush, heapq.heapreplace
        while open_:
            s, i = pop(open_)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = links[i][level]
            near = near[stamp[near] != now]
            if not len(near):
                continue
            stamp[near] = now
            sims = x[near] @ q
            if len(best) >= beam:
                good = sims > best[0][0]
                near, sims = near[good], sims[good]
            for s, j in zip(sims.tolist(), near.tolist(), strict=True):
                if len(best) < beam:
                    push(best, (s, j))
                    push(open_, (-s, j))
                elif s > best[0][0]:
                    replace(best, (s, j))
                    push(open_, (-s, j))
        best.sort(reverse=True)
        return best

    def _down(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        """The best node found on the levels above `to`."""
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for level in range(int(self.level[self.entry]), to, -1):
            at = self._layer(q, at, 1, level)
        return at

    def _choose(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Diverse neighbours: a candidate nearer to a chosen one than to the node waits until the others are taken."""
        if len(found) <= most:
            return np.array([j for _, j in found], np.int64)
        nodes = np.array([j for _, j in found], np.int64)
        sims = np.array([s for s, _ in found])
        among = self.x[nodes] @ self.x[nodes].T
        closest = np.full(len(nodes), -2.0)
        chosen: list[int] = []
        left: list[int] = []
        for k in range(len(nodes)):
            if closest[k] < sims[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                np.maximum(closest, among[k], out=closest)
            else:
                left.append(k)
        return nodes[chosen + left[: most - len(chosen)]]

    def _insert(self, i: int) -> None:
        q, top = self.x[i], int(self.level[i])
        at = self._down(q, min(top, int(self.level[self.entry])))
        for level in range(min(top, int(self.level[self.entry])), -1, -1):
            at = self._layer(q, at, BUILD_BEAM, level)
            most = NEIGHBOURS * 2 if level == 0 else NEIGHBOURS
            self.links[i][level] = self._choose(at, NEIGHBOURS)
            for j in self.links[i][level].tolist():
                near = np.append(self.links[j][level], i)
                if len(near) > most:
                    sims = self.x[near] @ self.x[j]
                    order = np.argsort(-sims, kind="stable")
                    near = self._choose([(float(sims[k]), int(near[k])) for k in order], most)
                self.links[j][level] = near
        if top > self.level[self.entry]:
            self.entry = i

    def within(self, q: np.ndarray, least: float, beam: int) -> np.ndarray:
        """The nodes found whose similarity with q is at least `least`; the beam widens until it reaches below that."""
        n = len(self.x)
        if beam >= n:
            return np.flatnonzero(self.x @ q >= least)
        at = self._down(q, 0)
        while True:
            found = self._layer(q, at, beam, 0)
            if len(found) < beam or found[-1][0] < least or beam >= n:
                return np.array([j for s, j in found if s >= least], np.int64)
            beam *= 2
