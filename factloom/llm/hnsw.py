"""Hierarchical navigable small-world graph over unit vectors, as flat neighbour arrays.

Vectors are inserted and searched in batches: one step expands the best open candidates of all queries of a batch
at once. All arrays are of fixed width, -1 stands for no neighbour.
"""

from __future__ import annotations

import math

import numpy as np

#: Neighbours of a node in the ground layer and above, candidates kept while building, and candidates expanded at once.
GROUND, UPPER, EF_BUILD, STEP = 16, 8, 16, 6
BATCH = 512
_NONE = np.float32(-4)


def levels_of(n: int, seed: int = 7) -> np.ndarray:
    """The top layer of each node: geometric, the same for the same n."""
    u = np.random.default_rng(seed).random(n)
    return np.floor(-np.log(np.maximum(u, 1e-12)) / math.log(UPPER)).astype(np.int64)


class Graph:
    """Built over x, rows of length one. Node i is row i."""

    def __init__(self, x: np.ndarray, ef: int = EF_BUILD) -> None:
        self.x, self.ef, n = x, ef, len(x)
        self.level = levels_of(n) if n else np.zeros(0, np.int64)
        top = min(int(self.level.max(initial=0)), 6)
        self.level = np.minimum(self.level, top)
        # Nodes of high layers first, so that each layer is there when lower ones are filled; else in order.
        self.order = np.argsort(-self.level, kind="stable")
        self.links = [np.full((n, GROUND if layer == 0 else UPPER), -1, np.int32) for layer in range(top + 1)]
        self.sims = [np.full(a.shape, _NONE, np.float32) for a in self.links]
        self.present = np.zeros(n, bool)
        self.tops = self.order[: min(n, 32)]  # entry points, compared with every query
        at = 0
        while at < n:
            size = max(32, min(BATCH, at // 2))
            self._insert(self.order[at : at + size])
            at += size

    def _insert(self, new: np.ndarray) -> None:
        x, q = self.x, self.x[new]
        inside = q @ q.T
        np.fill_diagonal(inside, _NONE)
        entry = self._enter(q)
        first = True
        for layer in range(len(self.links) - 1, -1, -1):
            here = np.flatnonzero(self.level[new] >= layer)
            if not first or self.present.any():
                ids, sims = self.search(q, layer, entry, self.ef if len(here) else 4) if layer == 0 or len(here) == len(new) else self._mixed(q, layer, entry, here)
                entry = ids[:, :4]
            else:
                ids, sims = np.full((len(new), 1), -1, np.int64), np.full((len(new), 1), _NONE, np.float32)
            first = False
            if not len(here):
                continue
            # Others of the batch are candidates too: the near ones are not in the graph yet.
            k = min(8, len(here))
            block = inside[np.ix_(here, here)]
            near = np.argpartition(-block, k - 1, axis=1)[:, :k] if k < len(here) else np.broadcast_to(np.arange(len(here)), block.shape)
            c = np.concatenate([ids[here], new[here][near]], axis=1)
            s = np.concatenate([sims[here], np.take_along_axis(block, near, 1)], axis=1)
            c, s = self._choose(c, s, self.links[layer].shape[1])
            self.links[layer][new[here]], self.sims[layer][new[here]] = c, s
            self._back(layer, new[here], c, s)
        self.present[new] = True

    def _mixed(self, q: np.ndarray, layer: int, entry: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Search with the full width for those that stay in this layer, narrowly for those that pass through."""
        ids, sims = np.full((len(q), self.ef), -1, np.int64), np.full((len(q), self.ef), _NONE, np.float32)
        for rows, ef in ((here, self.ef), (np.setdiff1d(np.arange(len(q)), here), 4)):
            if len(rows):
                i, s = self.search(q[rows], layer, entry[rows], ef)
                ids[rows, : i.shape[1]], sims[rows, : i.shape[1]] = i, s
        return ids, sims

    def _enter(self, q: np.ndarray) -> np.ndarray:
        tops = self.tops[self.present[self.tops]]
        if not len(tops):
            return np.full((len(q), 1), -1, np.int64)
        s = q @ self.x[tops].T
        k = min(4, len(tops))
        return tops[np.argpartition(-s, k - 1, axis=1)[:, :k]] if k < len(tops) else np.broadcast_to(tops, s.shape).copy()

    def _choose(self, c: np.ndarray, s: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours with spread: a candidate nearer to one already chosen than to the node comes after the others."""
        order = np.argsort(-s, axis=1)[:, : width + width // 2]
        c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
        n, k = c.shape
        v = self.x[np.maximum(c, 0)]
        mutual = np.matmul(v, v.transpose(0, 2, 1))
        real = s > _NONE
        kept = np.zeros((n, k), bool)
        # Half of the places go to the nearest whatever their spread: they are what is looked for.
        kept[:, : width // 2] = real[:, : width // 2]
        for j in range(width // 2, k):
            nearest = np.where(kept[:, :j], mutual[:, j, :j], _NONE).max(axis=1)
            kept[:, j] = real[:, j] & (nearest < s[:, j])
        rank = np.where(kept, 0, np.where(real, 1, 2)) * k + np.arange(k)
        pick = np.argsort(rank, axis=1)[:, :width]
        c, s = np.take_along_axis(c, pick, 1), np.take_along_axis(s, pick, 1)
        c = np.where(s > _NONE, c, -1)
        if c.shape[1] < width:
            c = np.pad(c, ((0, 0), (0, width - c.shape[1])), constant_values=-1)
            s = np.pad(s, ((0, 0), (0, width - s.shape[1])), constant_values=_NONE)
        return c, s

    def _back(self, layer: int, new: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        """Links from the chosen neighbours back; a full node chooses anew among its links and the new ones."""
        links, sims = self.links[layer], self.sims[layer]
        width = links.shape[1]
        ok = c.ravel() >= 0
        to, frm, sim = c.ravel()[ok], np.repeat(new, c.shape[1])[ok], s.ravel()[ok]
        if not len(to):
            return
        order = np.lexsort((-sim, to))
        to, frm, sim = to[order], frm[order], sim[order]
        head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        place = np.arange(len(to)) - np.repeat(head, np.diff(np.append(head, len(to))))
        fits = place < width
        nodes = to[head]
        row = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(to))))[fits]
        add_c, add_s = np.full((len(nodes), width), -1, np.int64), np.full((len(nodes), width), _NONE, np.float32)
        add_c[row, place[fits]], add_s[row, place[fits]] = frm[fits], sim[fits]
        old_c, old_s = links[nodes].astype(np.int64), sims[nodes]
        # A link both ways within one batch is there already.
        add_s[(add_c[:, :, None] == old_c[:, None, :]).any(axis=2)] = _NONE
        room = (old_c < 0).sum(axis=1)
        more = (add_s > _NONE).sum(axis=1)
        both_c, both_s = np.concatenate([old_c, add_c], axis=1), np.concatenate([old_s, add_s], axis=1)
        easy = more <= room
        if easy.any():
            o = np.argsort(-both_s[easy], axis=1)[:, :width]
            links[nodes[easy]] = np.where(np.take_along_axis(both_s[easy], o, 1) > _NONE, np.take_along_axis(both_c[easy], o, 1), -1)
            sims[nodes[easy]] = np.take_along_axis(both_s[easy], o, 1)
        if not easy.all():
            cc, ss = self._choose(both_c[~easy], both_s[~easy], width)
            links[nodes[~easy]], sims[nodes[~easy]] = cc, ss

    def search(self, q: np.ndarray, layer: int, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the ef best found for each query in a layer, best first; entry: ids to start from, -1 for none."""
        links, x, n = self.links[layer], self.x, len(self.x)
        b, width = len(q), links.shape[1]
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True  # where -1 points
        ids = np.full((b, ef), -1, np.int64)
        sims = np.full((b, ef), _NONE, np.float32)
        m = min(entry.shape[1], ef)
        e = entry[:, :m].astype(np.int64)
        ids[:, :m] = e
        sims[:, :m] = np.where(e >= 0, np.matmul(x[np.maximum(e, 0)], q[:, :, None])[:, :, 0], _NONE)
        np.put_along_axis(seen, e, True, axis=1)
        # An id given twice counts once.
        if m > 1:
            srt = np.sort(e, axis=1)
            if (srt[:, 1:] == srt[:, :-1]).any():
                for j in range(1, m):
                    twice = (e[:, j : j + 1] == e[:, :j]).any(axis=1)
                    sims[twice, j], ids[twice, j] = _NONE, -1
        is_open = sims > _NONE
        live = np.arange(b)
        step = min(STEP, ef)
        while len(live):
            rank = np.where(is_open[live], sims[live], _NONE)
            pick = np.argpartition(-rank, step - 1, axis=1)[:, :step] if step < ef else np.broadcast_to(np.arange(ef), rank.shape)
            good = np.take_along_axis(rank, pick, 1) > _NONE
            busy = good.any(axis=1)
            if not busy.all():
                live, pick, good = live[busy], pick[busy], good[busy]
                if not len(live):
                    break
            at = ids[live[:, None], pick]
            is_open[live[:, None], pick] = False
            near = np.where(good[:, :, None], links[at], -1).reshape(len(live), -1)
            near = np.where(near < 0, n, near)
            rows, cols = np.nonzero(~seen[live[:, None], near])
            if not len(rows):
                continue
            to = near[rows, cols]
            # A node reached twice in this step is taken once.
            flat = live[rows] * np.int64(n + 1) + to
            _, one = np.unique(flat, return_index=True)
            rows, cols, to = rows[one], cols[one], to[one]
            seen[live[rows], to] = True
            found = np.full(near.shape, _NONE, np.float32)
            found[rows, cols] = np.einsum("ij,ij->i", x[to], q[live[rows]])
            every = np.concatenate([sims[live], found], axis=1)
            names = np.concatenate([ids[live], near], axis=1)
            opened = np.concatenate([is_open[live], found > _NONE], axis=1)
            best = np.argpartition(-every, ef - 1, axis=1)[:, :ef]
            sims[live], ids[live], is_open[live] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1), np.take_along_axis(opened, best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        return np.where(sims > _NONE, np.take_along_axis(ids, order, 1), -1), sims

    def neighbours(self, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the k best found for every node, itself left out: the walk starts at the node itself."""
        n = len(self.x)
        out_i, out_s = np.full((n, k), -1, np.int64), np.full((n, k), _NONE, np.float32)
        for at in range(0, n, BATCH):
            rows = np.arange(at, min(at + BATCH, n))
            ids, sims = self.search(self.x[rows], 0, rows[:, None], max(ef, k + 1))
            sims = np.where(ids == rows[:, None], _NONE, sims)
            o = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            s = np.take_along_axis(sims, o, 1)
            out_i[rows, : o.shape[1]], out_s[rows, : o.shape[1]] = np.where(s > _NONE, np.take_along_axis(ids, o, 1), -1), s
        return out_i, out_s

    def find(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the k best found for other vectors, from the top layer down."""
        out = []
        for at in range(0, len(q), BATCH):
            part = q[at : at + BATCH]
            entry = self._enter(part)
            for layer in range(len(self.links) - 1, 0, -1):
                entry = self.search(part, layer, entry, 4)[0]
            out.append(tuple(a[:, :k] for a in self.search(part, 0, entry, max(ef, k))))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
