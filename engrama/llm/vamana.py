"""A robust-pruned directed graph over the unit vectors of one shard.

Points enter in growing batches.  A greedy beam search from fixed entry points
proposes the neighbours of each new point: the best points it met, those it walked
over and the nearest ones of its own batch.  Relaxed distance pruning keeps a proposal only if no kept one is
closer to it, by the factor ``alpha``, than the new point is; so the edges stay
diverse and lead out of dense groups.  Edges are added in both directions, and
a point with more than ``degree`` of them is pruned again.

All steps work on whole batches of points as arrays.
"""

from __future__ import annotations

import numpy as np

DEGREE = 64
BUILD_BEAM = 40
SEARCH_BEAM = 64
ALPHA = 1.03
ENTRIES = 64
PROPOSALS = 96
PEERS = 8
STRIDE = 512
BATCH = 512
NONE = np.float32(-9.0)


class Graph:
    def __init__(self, points: np.ndarray, seed: int = 0):
        self.n, dim = points.shape
        self.points = np.vstack([points, np.zeros((1, dim), np.float32)])
        self.edges = np.full((self.n + 1, DEGREE), self.n, np.int32)
        order = np.random.default_rng(seed).permutation(self.n)
        self.entries = order[:ENTRIES]
        done, size = min(1, self.n), 1
        while done < self.n:
            new = order[done : done + size]
            self._insert(new, order[: min(done, ENTRIES)])
            done += len(new)
            size = min(2 * size, BATCH)

    def search(self, queries: np.ndarray, starts: np.ndarray | None = None, beam: int = SEARCH_BEAM):
        """(points, similarities) of the best ``beam`` points met; unused places hold ``n``."""
        entries = np.tile(self.entries, (len(queries), 1))
        if starts is not None:
            entries = np.concatenate([starts[:, None], entries], axis=1)
        return self._beam(queries, entries, beam)[:2]

    def _beam(self, queries: np.ndarray, entries: np.ndarray, beam: int, width: int = 4):
        n, b = self.n, len(queries)
        rows = np.arange(b)
        seen = np.full((b, n + 1), -1, np.int32)
        seen[:, n] = 0
        ids = np.full((b, beam), n, np.int32)
        sims = np.full((b, beam), NONE)
        closed = np.ones((b, beam), bool)
        walked, walked_sims = [], []
        fresh_row, fresh = self._unseen(seen, np.repeat(rows, entries.shape[1]), entries.ravel())
        while True:
            if len(fresh):
                ids, sims, closed = self._merge(queries, ids, sims, closed, fresh_row, fresh)
            open_sims = np.where(closed, NONE, sims)
            top = np.argpartition(-open_sims, min(width, beam) - 1, axis=1)[:, :width]
            top_sims = np.take_along_axis(open_sims, top, 1)
            live = top_sims > -5
            if not live.any():
                return ids, sims, walked, walked_sims
            r, c = np.nonzero(live)
            closed[r, top[r, c]] = True
            at = np.where(live, np.take_along_axis(ids, top, 1), n)
            walked.append(at)
            walked_sims.append(np.where(live, top_sims, NONE))
            fresh_row, fresh = self._unseen(seen, np.repeat(r, DEGREE), self.edges[at[r, c]].ravel())

    def _unseen(self, seen: np.ndarray, row: np.ndarray, point: np.ndarray):
        """Distinct pairs that were not seen before, by row; they count as seen afterwards."""
        at = row * (self.n + 1) + point
        flat = seen.reshape(-1)
        new = flat[at] < 0
        row, point, at = row[new], point[new], at[new]
        mark = np.arange(len(at), dtype=np.int32)
        flat[at] = mark  # of equal pairs the last one stays
        first = flat[at] == mark
        return row[first], point[first]

    def _merge(self, queries, ids, sims, closed, row, point):
        b, beam = ids.shape
        s = np.empty(len(row), np.float32)
        for i in range(0, len(row), STRIDE):  # pieces that stay in the processor's cache
            part = slice(i, i + STRIDE)
            near = self.points.take(point[part], axis=0)
            np.einsum("ij,ij->i", near, queries.take(row[part], axis=0), out=s[part])
        count = np.bincount(row, minlength=b)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        more = np.full((b, count.max()), self.n, np.int32)
        more_sims = np.full(more.shape, NONE)
        more[row, place] = point
        more_sims[row, place] = s
        ids = np.concatenate([ids, more], axis=1)
        sims = np.concatenate([sims, more_sims], axis=1)
        closed = np.concatenate([closed, more_sims < -5], axis=1)
        best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        return tuple(np.take_along_axis(x, best, 1) for x in (ids, sims, closed))

    def _insert(self, new: np.ndarray, entries: np.ndarray) -> None:
        n, x = self.n, self.points
        ids, sims, walked, walked_sims = self._beam(x[new], np.tile(entries, (len(new), 1)), BUILD_BEAM)
        peers, peer_sims = self._peers(new)
        ids = np.concatenate([ids, *walked, peers], axis=1)
        sims = np.concatenate([sims, *walked_sims, peer_sims], axis=1)
        order = np.argsort(ids, axis=1, kind="stable")
        ids, sims = (np.take_along_axis(a, order, 1) for a in (ids, sims))
        again = np.zeros(ids.shape, bool)
        again[:, 1:] = ids[:, 1:] == ids[:, :-1]
        sims[again | (ids >= n)] = NONE
        self.edges[new] = self._prune(ids, sims)

        row, col = np.nonzero(self.edges[new] < n)
        back, to = new[row], self.edges[new][row, col]
        order = np.argsort(to, kind="stable")
        back, to = back[order], to[order]
        ends, start, count = np.unique(to, return_index=True, return_counts=True)
        added = np.full((len(ends), count.max()), n, np.int64)
        added[np.repeat(np.arange(len(ends)), count), np.arange(len(to)) - np.repeat(start, count)] = back
        both = np.sort(np.concatenate([self.edges[ends], added], axis=1), axis=1)
        fits = (both < n).sum(axis=1) <= DEGREE
        self.edges[ends[fits]] = both[fits, :DEGREE]
        full = np.flatnonzero(~fits)
        for i in range(0, len(full), BATCH):
            part = full[i : i + BATCH]
            near = both[part]
            near = near[:, : int((near < n).sum(axis=1).max())]
            s = np.einsum("bcd,bd->bc", x[near], x[ends[part]])
            s[near >= n] = NONE
            self.edges[ends[part]] = self._prune(near, s)

    def _peers(self, new: np.ndarray):
        """The nearest points of the same batch, which no search can meet yet."""
        s = self.points[new] @ self.points[new].T
        np.fill_diagonal(s, NONE)
        best = np.argpartition(-s, min(PEERS, len(new)) - 1, axis=1)[:, :PEERS]
        return new[best], np.take_along_axis(s, best, 1)

    def _prune(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """At most ``DEGREE`` diverse neighbours out of each row of proposals."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, :PROPOSALS]
        ids, sims = (np.take_along_axis(a, order, 1) for a in (ids, sims))
        ids = np.where(sims > -5, ids, self.n)
        out = np.full((len(ids), DEGREE), self.n, np.int32)
        rows = np.arange(len(ids))
        own = np.maximum(2 - 2 * sims, 0)
        v = self.points[ids]
        apart = np.maximum(2 - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0) * np.float32(ALPHA**2)
        alive = sims > -5
        for k in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            out[some, k] = ids[rows[some], first[some]]
            alive &= apart[rows, first] > own
            alive[rows, first] = False
        return out
