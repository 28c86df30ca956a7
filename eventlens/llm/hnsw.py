"""A hierarchical navigable small-world graph over one shard of unit vectors,
built and searched for many vectors at a time in numpy."""

from __future__ import annotations

import io

import numpy as np

LINKS = 16  #: links a node makes when it is added; it holds twice as many
BUILD_BEAM = 48
BATCH = 256


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row, largest first."""
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)


class Graph:
    """``layers``: from the ground up, per layer the nodes (ground numbers,
    the layer's own order) and a table of links in that order (-1: none)."""

    def __init__(self, vectors: np.ndarray):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []

    # -- building ---------------------------------------------------------
    def build(self, seed: int = 7) -> Graph:
        n = len(self.x)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int)
        top = max(0, int(level.max(initial=0)))
        while top and (level >= top).sum() < 2:
            top -= 1
        upper: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(top, -1, -1):
            above = upper[0][0] if upper else np.zeros(0, np.int64)
            new = np.nonzero(np.minimum(level, top) >= at)[0]
            nodes = np.concatenate([above, new[~np.isin(new, above)]])
            upper.insert(0, (nodes, self._layer(nodes, len(above), upper)))
        self.layers = upper
        return self

    def _layer(self, nodes: np.ndarray, first: int, upper: list) -> np.ndarray:
        """Links among ``nodes``; the first ones are those of the layer above."""
        x, n = self.x[nodes], len(nodes)
        links = np.full((n, 2 * LINKS), -1, np.int32)
        done = 0
        while done < n:
            size = min(BATCH, n - done, max(32, done)) if done else min(n, max(first, 1) if first else 32, BATCH)
            rows = np.arange(done, done + size)
            among = x[rows] @ x[rows].T
            among[np.arange(size), np.arange(size)] = -np.inf
            own = _top(among, BUILD_BEAM)
            cand, sims = rows[own], np.take_along_axis(among, own, 1)
            if done:
                entry = self._descend(x[rows], upper) if upper else np.zeros(size, np.int64)
                entry = np.minimum(entry, done - 1)  # a node of the layer above has the same number here
                found, fs, _ = self._beam(x[rows], x[:done], links[:done], entry[:, None], BUILD_BEAM, None)
                cand, sims = np.concatenate([cand, found], 1), np.concatenate([sims, fs], 1)
            chosen = self._spread(x, cand, np.where(cand >= 0, sims, -np.inf), LINKS)
            links[rows, : chosen.shape[1]] = chosen
            self._back(x, links, rows, chosen)
            done += size
        return links

    @staticmethod
    def _spread(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates the nearest that are nearer to the row
        than to one already chosen, then the nearest of the others."""
        order = _top(sims, 3 * most)
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        v = x[np.maximum(cand, 0)]
        mutual = np.einsum("bid,bjd->bij", v, v)
        taken = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            closest = np.where(taken[:, :j], mutual[:, j, :j], -np.inf).max(axis=1, initial=-np.inf)
            taken[:, j] = np.isfinite(sims[:, j]) & (sims[:, j] > closest)
        rank = np.where(np.isfinite(sims), np.where(taken, 0, 1), 2) * cand.shape[1] + np.arange(cand.shape[1])
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.isfinite(np.take_along_axis(sims, pick, 1)), np.take_along_axis(cand, pick, 1), -1)

    def _back(self, x: np.ndarray, links: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> None:
        """Add the links back; a node with too many keeps a spread choice."""
        frm, to = np.repeat(rows, chosen.shape[1]), chosen.ravel()
        real = to >= 0
        order = np.argsort(to[real], kind="stable")
        frm, to = frm[real][order], to[real][order]
        targets, start, counts = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(targets), int(counts.max(initial=0))), -1, np.int64)
        extra[np.repeat(np.arange(len(targets)), counts), np.arange(len(to)) - np.repeat(start, counts)] = frm
        both = np.concatenate([links[targets].astype(np.int64), extra], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # linked already
        both = -np.sort(-both, axis=1)
        width = links.shape[1]
        fits = (both >= 0).sum(axis=1) <= width
        links[targets[fits]] = both[fits, :width] if both.shape[1] >= width else np.pad(both[fits], ((0, 0), (0, width - both.shape[1])), constant_values=-1)
        full = np.nonzero(~fits)[0]
        for at in range(0, len(full), BATCH):
            part = full[at : at + BATCH]
            b = both[part]
            sims = np.where(b >= 0, np.einsum("bd,bjd->bj", x[targets[part]], x[np.maximum(b, 0)]), -np.inf)
            links[targets[part]] = self._spread(x, b, sims, width)

    # -- searching --------------------------------------------------------
    @staticmethod
    def _beam(q: np.ndarray, x: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int, seen: np.ndarray | None):
        """Best-first search of all queries at once: each keeps its ``beam``
        best nodes and follows the links of the best not yet followed.
        Returns nodes, similarities and every similarity that was looked at
        (-inf: not looked at)."""
        n, b = len(x), len(q)
        rows = np.arange(b)[:, None]
        looked = np.full((b, n + 1), -np.inf, np.float32) if seen is None else seen
        looked[:, n] = np.inf  # the place of absent links
        nodes = np.where(looked[rows, entry] == -np.inf, entry, n) if seen is None else entry
        sims = np.einsum("bd,bkd->bk", q, x[np.minimum(nodes, n - 1)])
        sims[nodes == n] = -np.inf
        looked[rows, np.where(nodes == n, n, nodes)] = np.where(nodes == n, np.inf, sims)
        followed = np.zeros(nodes.shape, bool)
        live = np.arange(b)
        step = 4
        while len(live):
            open_sims = np.where(followed[live], -np.inf, sims[live])
            pick = _top(open_sims, step)
            good = np.take_along_axis(open_sims, pick, 1) > -np.inf
            some = good.any(axis=1)
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            at = live[:, None]
            followed[at, pick] |= good
            nxt = np.where(good[:, :, None], links[np.minimum(nodes[at, pick], n - 1)], -1).reshape(len(live), -1)
            nxt = np.where(nxt < 0, n, nxt)
            fresh = looked[at, nxt] == -np.inf
            nxt = np.sort(np.where(fresh, nxt, n), axis=1)
            nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = n
            keep = int((nxt < n).sum(axis=1).max(initial=0))
            if not keep:
                continue
            nxt = np.sort(nxt, axis=1)[:, :keep]
            s = np.einsum("bd,bkd->bk", q[live], x[np.minimum(nxt, n - 1)])
            s[nxt == n] = -np.inf
            looked[at, nxt] = np.where(nxt == n, np.inf, s)
            all_n, all_s = np.concatenate([nodes[live], nxt], 1), np.concatenate([sims[live], s], 1)
            all_f = np.concatenate([followed[live], nxt == n], 1)
            best = _top(all_s, beam)
            if nodes.shape[1] < best.shape[1]:
                grow = ((0, 0), (0, best.shape[1] - nodes.shape[1]))
                nodes, sims = np.pad(nodes, grow, constant_values=n), np.pad(sims, grow, constant_values=-np.inf)
                followed = np.pad(followed, grow, constant_values=True)
            w = best.shape[1]
            nodes[at, np.arange(w)] = np.take_along_axis(all_n, best, 1)
            sims[at, np.arange(w)] = np.take_along_axis(all_s, best, 1)
            followed[at, np.arange(w)] = np.take_along_axis(all_f, best, 1)
            nodes[live, w:], sims[live, w:], followed[live, w:] = n, -np.inf, True
        return np.where(nodes == n, -1, nodes), sims, looked

    def _descend(self, q: np.ndarray, layers: list) -> np.ndarray:
        """From the top layer of ``layers`` (lowest first) down: the place,
        in the lowest of them, of the nearest node found."""
        entry = np.zeros((len(q), 1), np.int64)
        for nodes, links in reversed(layers):
            found, _, _ = self._beam(q, self.x[nodes], links, entry, 8, None)
            entry = np.maximum(found[:, :1], 0)  # nodes of a layer come first, in the same order, in the one below
        return entry[:, 0]

    def search(self, q: np.ndarray, beam: int, at_least: float) -> np.ndarray:
        """For each query and node the similarity, where it was looked at
        (-inf elsewhere). The beam widens by itself for what reaches
        ``at_least``: the links of every such node are followed."""
        q = np.ascontiguousarray(q, np.float32)
        nodes, links = self.layers[0]
        entry = self._descend(q, self.layers[1:]) if len(self.layers) > 1 else np.zeros(len(q), np.int64)
        place = np.empty(len(nodes), np.int64)
        place[nodes] = np.arange(len(nodes))
        x = self.x[nodes]
        _, _, looked = self._beam(q, x, links, entry[:, None], beam, None)
        n = len(nodes)
        todo = (looked[:, :n] >= at_least)
        while True:
            row, col = np.nonzero(todo)
            if not len(row):
                return looked[:, place]
            r, c = np.repeat(row, links.shape[1]), links[col].ravel()
            c = np.where(c < 0, n, c)
            new = looked[r, c] == -np.inf
            pair = np.unique(r[new] * (n + 1) + c[new])
            r, c = pair // (n + 1), pair % (n + 1)
            s = np.concatenate([np.einsum("kd,kd->k", q[r[a : a + 65536]], x[c[a : a + 65536]]) for a in range(0, max(1, len(r)), 65536)])
            looked[r, c] = s
            todo = np.zeros_like(todo)
            near = s >= at_least
            todo[r[near], c[near]] = True

    # -- storing ----------------------------------------------------------
    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"{k}{i}": a for i, layer in enumerate(self.layers) for k, a in zip("nl", layer)})
        return out.getvalue()

    @staticmethod
    def load(vectors: np.ndarray, data: bytes) -> Graph:
        g = Graph(vectors)
        with np.load(io.BytesIO(data)) as z:
            g.layers = [(z[f"n{i}"], z[f"l{i}"]) for i in range(len(z.files) // 2)]
        return g
