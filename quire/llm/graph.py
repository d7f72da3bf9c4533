"""Robust-pruned directed graphs over unit-bounded vectors, built and searched for many vectors at a time."""

from __future__ import annotations

import numpy as np

FAR = np.float32(3.4e38)


class Graph:
    """A graph over the rows of x; near is by squared distance. Rows join in growing batches.

    Each batch searches the graph so far for its neighbours (greedy searches from the medoid), prunes what it met, and
    links back; a row with too many links is pruned again. Pruning keeps a neighbour unless a nearer one that was kept
    is closer to it by the factor `relax`, so that long edges survive.
    """

    def __init__(self, x: np.ndarray, degree: int = 24, beam: int = 64, relax: float = 1.2, links: np.ndarray | None = None):
        self.x = np.ascontiguousarray(x, np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.degree, self.relax = degree, np.float32(relax**2)
        n = len(x)
        self.links = np.full((n, degree), -1, np.int32) if links is None else links
        self.entry = int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin()) if n else 0
        if links is None and n > 1:
            order = np.random.default_rng(n).permutation(n).astype(np.int32)
            order = np.concatenate([[self.entry], order[order != self.entry]]).astype(np.int32)
            at, size = 1, 1
            while at < n:
                self._insert(order[at : at + size], beam)
                at += size
                size = min(max(1, at), 1024)

    def _insert(self, new: np.ndarray, beam: int) -> None:
        met, gap = self.search(self.x[new], beam)
        own = (met != new[:, None]) & (met >= 0)
        if len(new) > 1:  # of a batch, the nearest of its own rows too
            d = self.norm[new][:, None] + self.norm[new] - 2 * self.x[new] @ self.x[new].T
            np.fill_diagonal(d, FAR)
            k = min(len(new) - 1, self.degree)
            some = np.argpartition(d, k - 1, 1)[:, :k]
            met = np.concatenate([met, new[some]], 1)
            gap = np.concatenate([np.where(own, gap, FAR), np.take_along_axis(d, some, 1)], 1)
        else:
            gap = np.where(own, gap, FAR)
        self.links[new] = self._prune(met, gap)
        src = np.repeat(new, self.degree)
        dst = self.links[new].ravel()
        back = (dst >= 0) & ~(self.links[dst] == src[:, None]).any(1)
        src, dst = src[back], dst[back]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        begin = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.empty(0, np.int64)
        rows = dst[begin]
        count = np.diff(np.concatenate([begin, [len(dst)]]))
        wide = np.full((len(rows), int(count.max(initial=0))), -1, np.int32)
        wide[np.repeat(np.arange(len(rows)), count), np.arange(len(dst)) - np.repeat(begin, count)] = src
        had = (self.links[rows] >= 0).sum(1)
        every = np.concatenate([self.links[rows], wide], 1)
        fits = had + count <= self.degree
        packed = -np.sort(-np.where(every >= 0, every, -1), 1)
        self.links[rows[fits]] = packed[fits][:, : self.degree]
        for part in np.array_split(np.flatnonzero(~fits), -(-max(1, (~fits).sum()) // 512)):
            if len(part):
                e = packed[part]
                e = e[:, : max(1, int((e >= 0).sum(1).max()))]
                d = self._gaps(self.x[rows[part]], self.norm[rows[part]], e)
                self.links[rows[part]] = self._prune(e, np.where(e == rows[part][:, None], FAR, d))

    def _gaps(self, q: np.ndarray, norm: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = norm[:, None] + self.norm[rows] - 2 * np.matmul(self.x[rows], q[:, :, None])[:, :, 0]
        return np.where(rows >= 0, np.maximum(d, 0), FAR)

    def _prune(self, met: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Of the candidates of each row those that no kept, nearer one stands for."""
        order = np.argsort(gap, 1)[:, : 3 * self.degree]
        met, gap = np.take_along_axis(met, order, 1), np.take_along_axis(gap, order, 1)
        n, m = met.shape
        v = self.x[met]
        norm = self.norm[met]
        out = np.full((n, self.degree), -1, np.int32)
        count = np.zeros(n, np.int64)
        alive = gap < FAR
        rows = np.arange(n)
        for _ in range(self.degree):
            first = alive.argmax(1)
            has = alive[rows, first]
            if not has.any():
                break
            out[rows[has], count[has]] = met[rows[has], first[has]]
            count += has
            p = v[rows, first]
            d = norm + norm[rows, first][:, None] - 2 * np.matmul(v, p[:, :, None])[:, :, 0]
            alive &= ~(has[:, None] & (self.relax * np.maximum(d, 0) <= gap))
            alive[rows, first] = False
        return out

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the rows of a beam, nearest first, and their squared distances; -1 where there are fewer."""
        q = np.ascontiguousarray(q, np.float32)
        most = max(32, min(1024, (1 << 25) // max(1, len(self.x))))  # what has been seen is marked for every query and row
        if len(q) > most:
            parts = [self.search(p, beam) for p in np.array_split(q, -(-len(q) // most))]
            return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        n = len(q)
        norm = np.einsum("ij,ij->i", q, q)
        ids = np.full((n, beam), -1, np.int32)
        gap = np.full((n, beam), FAR, np.float32)
        done = np.zeros((n, beam), bool)
        ids[:, 0] = self.entry
        gap[:, 0] = self._gaps(q, norm, ids[:, :1])[:, 0]
        seen = np.zeros((n, len(self.x)), bool)
        seen[:, self.entry] = True
        live = np.arange(n)
        while len(live):
            open_ = ~done[live] & (ids[live] >= 0)
            some = open_.any(1)
            live, open_ = live[some], open_[some]
            if not len(live):
                break
            at = open_.argmax(1)
            done[live, at] = True
            nbr = self.links[ids[live, at]]
            new = (nbr >= 0) & ~seen[live[:, None], nbr]
            seen[np.broadcast_to(live[:, None], nbr.shape)[new], nbr[new]] = True
            nbr = np.where(new, nbr, -1)
            d = self._gaps(q[live], norm[live], nbr)
            every, dist, marks = np.concatenate([ids[live], nbr], 1), np.concatenate([gap[live], d], 1), np.concatenate([done[live], ~new], 1)
            order = np.argsort(dist, 1, kind="stable")[:, :beam]
            ids[live], gap[live], done[live] = np.take_along_axis(every, order, 1), np.take_along_axis(dist, order, 1), np.take_along_axis(marks, order, 1)
        return ids, gap

    def within(self, q: np.ndarray, radius: np.ndarray, beam: int) -> list[np.ndarray]:
        """For each query all rows met whose squared distance is at most its radius.

        A beam search leads to the query's surroundings; from there every row within the radius is expanded until no
        new one turns up.
        """
        ids, gap = self.search(q, beam)
        out = []
        for k in range(len(q)):
            todo = [int(i) for i, d in zip(ids[k], gap[k], strict=True) if i >= 0 and d <= radius[k]]
            found = set(todo)
            seen = set(ids[k].tolist())
            while todo:
                nbr = np.unique(self.links[todo])
                nbr = np.array([i for i in nbr.tolist() if i >= 0 and i not in seen], np.int64)
                if not len(nbr):
                    break
                seen.update(nbr.tolist())
                d = ((self.x[nbr] - q[k]) ** 2).sum(1)
                todo = nbr[d <= radius[k]].tolist()
                found.update(todo)
            out.append(np.array(sorted(found), np.int64))
        return out
