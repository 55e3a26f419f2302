"""Search, expansion and pool of a query in one task, over a corpus and a graph that every task holds.

A query reaches thousands of candidates by tens of thousands of paths, so what it makes on its way is far larger than
the corpus.  Where corpus and graph fit a task (``HELD_BYTES``), nothing but the result leaves it; larger ones are left
to the joins of ``expand`` and ``pool``, which give the same rows.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import TINY
from ..plans.stage import together
from .expand import DECAY, STEP, Expansion
from .graph import Graph, capped_edges
from .semantic import DIGITS, _unit

#: Bytes that every task may hold: two tasks share an executor.
HELD_BYTES = 384 << 20
#: Queries and corpus rows that are compared at once; corpus rows looked at to guess a threshold; rows of an output batch.
QUERIES, ROWS, LOOK, OUT_ROWS = 256, 8_192, 4_096, 50_000
#: More than single precision and rounding can move a cosine by.
MARGIN = 1e-5


@dataclass
class Rows:
    """Rows of a key one after another: the places of key k are ptr[k] to ptr[k + 1].  w: what a score is multiplied by, or one number if all are equal."""

    ptr: np.ndarray
    to: np.ndarray
    rel: np.ndarray
    w: np.ndarray | float

    @staticmethod
    def of(n: int, key: np.ndarray, to: np.ndarray, rel: np.ndarray, w: np.ndarray, limit: int | None = None, once: bool = False) -> Rows:
        """Heaviest first, then by ``to`` and ``rel``; the first ``limit`` of each key.  ``once``: the first of each pair."""
        by = np.lexsort((rel, to, -w, key))
        key, to, rel, w = (x[by] for x in (key, to, rel, w))
        if limit is not None:
            starts = np.searchsorted(key, np.arange(n))
            keep = np.arange(len(key)) - starts[key] < limit
            key, to, rel, w = (x[keep] for x in (key, to, rel, w))
        if once and len(key):
            _, first = np.unique(key.astype(np.int64) * (int(to.max()) + 1) + to, return_index=True)
            first.sort()
            key, to, rel, w = (x[first] for x in (key, to, rel, w))
        w = np.maximum(w, 0.0)
        same = float(w[0]) if len(w) and (w == w[0]).all() else 1.0 if not len(w) else w
        return Rows(np.searchsorted(key, np.arange(n + 1)).astype(np.int64), to.astype(np.int32), rel.astype(np.int16 if len(rel) == 0 or rel.max() < 2**15 else np.int32), same)

    def of_keys(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys, place) of all their rows, in order."""
        a, n = self.ptr[keys], self.ptr[keys + 1] - self.ptr[keys]
        from_ = np.repeat(np.arange(len(keys)), n)
        return from_, np.arange(len(from_)) + np.repeat(a - (np.cumsum(n) - n), n)

    def weight(self, at: np.ndarray) -> np.ndarray | float:
        return self.w if isinstance(self.w, float) else self.w[at]


@dataclass
class Held:
    """Candidates are numbered by id; nodes and ``candidate::`` names together by name, so numbers sort as the names do."""

    ids: pa.Array
    names: pa.Array
    own: np.ndarray  # a candidate's place among the names
    relations: pa.Array
    x: np.ndarray  # unit vectors
    raw: np.ndarray  # as they were given: the same array where they are of length one
    start: Rows  # candidate to node
    links: Rows  # node to candidate
    edges: Rows  # node to node


class Packed:
    """Something that is sent to all executors and lies on their disks, so compressed; a worker opens it once."""

    def __init__(self, what):
        raw = pickle.dumps(what, protocol=5)
        self.size, self.data, self.what = len(raw), pa.compress(raw, "zstd", asbytes=True), None

    def open(self):
        if self.what is None:
            self.what, self.data = pickle.loads(pa.decompress(self.data, self.size, "zstd", asbytes=True)), None
        return self.what


def hold(graph: Graph, corpus: DataFrame, vectors: DataFrame, e: Expansion) -> Held | None:
    """Corpus and graph as arrays; None where they are too large to be held, or not every candidate has its one vector."""
    size = F.size("vector")
    n, ids, short, dim = vectors.agg(F.count("*"), F.count_distinct("candidate_id"), F.coalesce(F.min(F.when(F.col("vector").isNull(), -1).otherwise(size)), F.lit(-1)), F.coalesce(F.max(size), F.lit(-1))).first()
    if not n or ids != n or short != dim or dim < 1 or corpus.count() != n:
        return None
    edges = capped_edges(graph.edges, e.neighbours).select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b"), "relation", F.col("weight").cast("double").alias("w"))
    more, others, missing = together(lambda df: df.count(), [graph.links, graph.edges, corpus.join(vectors, "candidate_id", "left_anti")])
    if missing or n * (8 * dim + 120) + 28 * more + 24 * others > HELD_BYTES:
        return None
    nodes = graph.links.select(F.col("node_id").alias("n")).unionByName(graph.edges.select(F.col("source").alias("n"))).unionByName(graph.edges.select(F.col("target").alias("n"))).where("n is not null").distinct().select("n", F.xxhash64("n").alias("h"))
    links = graph.links.select(F.xxhash64("candidate_id").alias("a"), F.xxhash64("node_id").alias("b"), "relation", F.col("weight").cast("double").alias("w")).where("candidate_id is not null and node_id is not null")
    table, nodes, links, edges = together(lambda df: df.toArrow(), [vectors.select("candidate_id", F.xxhash64("candidate_id").alias("h"), F.col("vector").cast("array<double>").alias("vector")), nodes, links, edges])
    table = table.combine_chunks()
    by = np.argsort(table["candidate_id"].to_numpy(zero_copy_only=False))
    ids = table["candidate_id"].combine_chunks().take(pa.array(by))
    raw = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), dim) for c in table["vector"].chunks])[by]
    candidates = table["h"].to_numpy()[by]
    del table
    norm = np.linalg.norm(raw, axis=1, keepdims=True)
    if np.abs(norm - 1)[norm > 0].max(initial=0) < 1e-12:
        raw /= np.maximum(norm, TINY)
        x = raw
    else:
        x = raw / np.maximum(norm, TINY)
    mine = pc.binary_join_element_wise("candidate::", ids, "")
    every = sorted({*nodes["n"].to_pylist(), *mine.to_pylist()})  # by code point, which is the order of the bytes
    names = pa.array(every, pa.string())
    own, place = pc.index_in(mine, value_set=names).to_numpy().astype(np.int32), pc.index_in(nodes["n"].combine_chunks(), value_set=names).to_numpy().astype(np.int32)
    relations = sorted({*links["relation"].unique().to_pylist(), *edges["relation"].unique().to_pylist()} - {None})
    if links["relation"].null_count or edges["relation"].null_count or links["w"].null_count or edges["w"].null_count:
        return None

    def numbers(hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        known, values = hashes[order], values[order]
        if (known[1:] == known[:-1]).any():  # two names of one hash: left to the joins
            return None

        def look(h: np.ndarray) -> np.ndarray | None:
            i = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            return values[i] if not len(h) or (len(known) and (known[i] == h).all()) else None

        return look

    of_candidate, of_node = numbers(candidates, np.arange(n, dtype=np.int32)), numbers(nodes["h"].to_numpy(), place)
    if of_candidate is None or of_node is None:
        return None
    relation = pa.array(relations, pa.string())
    code = lambda t: pc.index_in(t["relation"].combine_chunks(), value_set=relation).to_numpy().astype(np.int32)
    lc, ln, es, et = of_candidate(links["a"].to_numpy()), of_node(links["b"].to_numpy()), of_node(edges["a"].to_numpy()), of_node(edges["b"].to_numpy())
    if any(v is None for v in (lc, ln, es, et)):
        return None
    lw, ew = links["w"].to_numpy(), edges["w"].to_numpy()
    start = Rows.of(n, lc, ln, code(links), lw)
    return Held(ids, names, own, relation, x, raw, start, Rows.of(len(names), ln, lc, code(links), lw, e.candidates_per_node), Rows.of(len(names), es, et, code(edges), ew, once=True))


def rounded(x: np.ndarray) -> np.ndarray:
    """To DIGITS places, halves away from zero, as SQL does."""
    return np.trunc(x * 10.0**DIGITS + np.copysign(0.5, x)) / 10.0**DIGITS


def shown(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Numbers from 0 on to so many places as Spark's ``round`` has them: halves of the written number go up."""
    if digits is None:
        return x
    y = x * 10.0**digits
    low = np.floor(y)
    out = np.floor(y + 0.5) / 10.0**digits
    for i in np.flatnonzero(np.abs(y - low - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _lists(column: pa.Array, ids: pa.Array) -> list[np.ndarray | None]:
    """The numbers of each row's candidates, without unknown ones; None for null."""
    flat, rows = column.flatten(), column.is_null().to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(flat, value_set=ids, skip_nulls=True), -1).to_numpy().astype(np.int64)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    out = [None if no else at[a:b] for no, a, b in zip(rows, [0, *ends], ends)]
    return [None if v is None else v[v >= 0] for v in out]


def _longer(path: np.ndarray, rel: np.ndarray, node: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths and relations with one step more."""
    end, n = np.full((len(path), 1), -1, np.int32), np.arange(len(path))
    path, rel = np.concatenate([path, end], 1), np.concatenate([rel, end], 1)
    path[n, (path >= 0).sum(1)], rel[n, (rel >= 0).sum(1)] = node, r
    return path, rel


class _Tree:
    """Paths that share their beginnings: an entry has its node, its relation and the entry before it."""

    def __init__(self, path: np.ndarray, rel: np.ndarray):
        self.first = [([v for v in p if v >= 0], [v for v in r if v >= 0]) for p, r in zip(path.tolist(), rel.tolist())]
        self.size, self.starts, self.parts = len(self.first), [], []

    def grow(self, parent: int, nodes: np.ndarray, rels: np.ndarray) -> np.ndarray:
        self.starts.append(self.size)
        self.parts.append((parent, nodes, rels))
        self.size += len(nodes)
        return np.arange(self.size - len(nodes), self.size)

    def paths(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chains = []
        for e in entries.tolist():
            p, r = [], []
            while e >= len(self.first):
                i = bisect_right(self.starts, e) - 1
                parent, nodes, rels = self.parts[i]
                p.append(int(nodes[e - self.starts[i]]))
                r.append(int(rels[e - self.starts[i]]))
                e = parent
            chains.append((self.first[e][0] + p[::-1], self.first[e][1] + r[::-1]))
        width = max([2, *(len(p) for p, _ in chains)])
        fill = lambda rows, w: np.array([[*x, *[-1] * (w - len(x))] for x in rows], np.int32).reshape(len(rows), w)
        return fill([p for p, _ in chains], width), fill([r for _, r in chains], width - 1)


class Walker:
    """Runs queries one after another over what is held."""

    def __init__(self, held: Held, e: Expansion, k: int, seed_k: int, in_order: bool):
        self.h, self.e, self.k, self.seed_k, self.in_order = held, e, k, seed_k, in_order
        n = len(held.names)
        self.seen, self.place = np.zeros(n, bool), np.zeros(max(n, len(held.ids)), np.int32)
        self.best, self.now, self.at = np.full(n, -np.inf), np.zeros(n), np.zeros(n, np.int64)
        self.decay = np.array([math.exp(-DECAY * (d + 1)) for d in range(e.hops + 1)])

    # ---- Search ---------------------------------------------------------------------------------------------------------

    def search(self, q: np.ndarray, no: list, yes: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """(candidate, score) of the k best of each query, best first.

        Single precision proposes all that may be among them, double precision decides.
        """
        x, k, m = self.h.x, self.k, len(self.h.x)
        out: list = [None] * len(q)
        free = np.array([i for i in range(len(q)) if yes[i] is None], np.int64)
        for i in range(len(q)):
            if yes[i] is not None:
                out[i] = self._order(q[i], np.setdiff1d(yes[i], no[i] if no[i] is not None else []).astype(np.int64))
        for a in range(0, len(free), QUERIES):
            rows = free[a : a + QUERIES]
            q32 = q[rows].astype(np.float32)
            want = np.array([k + (0 if no[i] is None else len(no[i])) for i in rows])  # what is excluded is dropped below
            step = max(1, m // LOOK)
            some = q32 @ x[::step].astype(np.float32).T
            ranks = np.ceil(want / step + (0 if step == 1 else 1) * (3 * np.sqrt(want / step) + 8)).astype(int)
            cut = int(min(ranks.max(), some.shape[1]))
            least = np.partition(some, some.shape[1] - cut, axis=1)[:, some.shape[1] - cut] - MARGIN
            found_r, found_c, wide = [], [], np.zeros(len(rows), bool)
            for b in range(0, m, ROWS):
                near = q32 @ x[b : b + ROWS].astype(np.float32).T >= least[:, None]
                if near.sum() > near.size // 4:  # many equal ones: those queries go through the corpus one after another
                    wide |= near.sum(1) > near.shape[1] // 8
                    near[wide] = False
                at = np.flatnonzero(near)
                found_r.append(at // near.shape[1])
                found_c.append(at % near.shape[1] + b)
            r, c = np.concatenate(found_r), np.concatenate(found_c)
            by = np.argsort(r, kind="stable")
            c, ends = c[by], np.searchsorted(r[by], np.arange(1, len(rows) + 1))
            for j, (i, u, v) in enumerate(zip(rows, [0, *ends], ends)):
                gone = no[i] if no[i] is not None and len(no[i]) else None
                some = lambda c, gone=gone: c if gone is None else np.setdiff1d(c, gone)
                best = None if wide[j] else self._order(q[i], some(c[u:v]))
                if best is None or len(best[0]) < k or best[1][-1] <= least[j] + MARGIN / 2:  # the guess was too high: all are looked at
                    best = self._order(q[i], some(np.arange(m)))
                out[i] = best
        return out

    def cosine(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        return rounded(self.h.x[c] @ q)

    def _order(self, q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.cosine(q, c)
        if len(s) > 4 * self.k:
            keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            c, s = c[keep], s[keep]
        by = np.lexsort((c, -s))[: self.k]
        return c[by], s[by]

    # ---- Expansion ------------------------------------------------------------------------------------------------------

    def _first(self, values: np.ndarray) -> np.ndarray:
        """Whether each is the first of its value."""
        at = np.arange(len(values), dtype=np.int32)
        self.place[values[::-1]] = at[::-1]
        return self.place[values] == at

    def _front(self, node: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.lexsort((node, -score))[: self.e.nodes_per_hop]

    def fronts(self, seeds: np.ndarray, scores: np.ndarray):
        """(score, depth, node, path, relations) of all nodes that are expanded; paths have -1 after their end."""
        h, e, touched = self.h, self.e, []
        from_, at = h.start.of_keys(seeds)
        s, t = scores[from_] * h.start.weight(at), h.start.to[at]
        by = np.argsort(-s, kind="stable")
        by = by[self._first(t[by])]
        self.best[t[by]] = s[by]
        touched.append(t[by])
        f = by[self._front(t[by], s[by])]
        node, score = t[f], s[f]
        path, rel = np.stack([h.own[seeds[from_[f]]], node], 1), h.start.rel[at[f]][:, None].astype(np.int32)
        self.seen[node] = True
        out = [(score, 0, node, path, rel)]
        for d in range(e.hops):
            from_, at = h.edges.of_keys(node)
            s, t = score[from_] * STEP * h.edges.weight(at), h.edges.to[at]
            if self.in_order and self._uses_new(node, from_, t, s):
                t, s, entry, tree = self._hop_in_order(node, score, path, rel)
                touched.append(t)
                new = np.flatnonzero(~self.seen[t])
                f = new[self._front(t[new], s[new])]
                path, rel = tree.paths(entry[f])
            else:
                if not isinstance(h.edges.w, float):
                    by = np.argsort(-s, kind="stable")
                    from_, at, s, t = from_[by], at[by], s[by], t[by]
                new = self._first(t) & (s > self.best[t])
                from_, at, s, t = from_[new], at[new], s[new], t[new]
                self.best[t] = s
                touched.append(t)
                new = np.flatnonzero(~self.seen[t])
                f = new[self._front(t[new], s[new])]
                path, rel = _longer(path[from_[f]], rel[from_[f]], t[f], h.edges.rel[at[f]])
            node, score = t[f], s[f]
            self.seen[node] = True
            out.append((score, d + 1, node, path, rel))
        for t in touched:
            self.best[t], self.seen[t] = -np.inf, False
        width = max(p.shape[1] for *_, p, _ in out)
        pad = lambda a, w: np.concatenate([a, np.full((len(a), w - a.shape[1]), -1, np.int32)], 1) if a.shape[1] < w else a
        return np.concatenate([o[0] for o in out]), np.repeat(np.arange(len(out)), [len(o[0]) for o in out]), np.concatenate([o[2] for o in out]), np.concatenate([pad(o[3], width) for o in out]), np.concatenate([pad(o[4], width - 1) for o in out])

    def _uses_new(self, node: np.ndarray, from_: np.ndarray, t: np.ndarray, s: np.ndarray) -> bool:
        """Whether a hop may improve a node that is still to be expanded in it (else its order doesn't matter)."""
        self.at[node] = np.arange(len(node))
        mine = self.seen[t] & (s > self.best[t])
        some = t[mine]
        return bool((np.isin(some, node) & (self.at[some] >= from_[mine])).any())

    def _hop_in_order(self, node: np.ndarray, score: np.ndarray, path: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Tree]:
        """(node, score, entry of the tree) of what one hop improves, node after node: a path that was improved earlier
        in it is already used by later nodes."""
        edges, best, all_t, tree = self.h.edges, self.best, [], _Tree(path, rel)
        now, at = self.now, self.at  # score and entry of the nodes that are expanded; entry of all that are improved
        now[node], at[node] = score, np.arange(len(node))
        for n in node.tolist():
            a, b = int(edges.ptr[n]), int(edges.ptr[n + 1])
            while a < b:
                t = edges.to[a:b]
                s = (now[n] * STEP) * (np.full(b - a, edges.w) if isinstance(edges.w, float) else edges.w[a:b])
                better, end = np.flatnonzero(s > best[t]), b
                t, s = t[better], s[better]
                itself = np.flatnonzero(t == n)
                if len(itself):  # its own path is improved: the rest of its edges uses it
                    t, s, end = t[: itself[0] + 1], s[: itself[0] + 1], a + int(better[itself[0]]) + 1
                    better = better[: itself[0] + 1]
                if len(t):
                    best[t], now[t] = s, s
                    at[t] = tree.grow(int(at[n]), t, edges.rel[a + better])
                    all_t.append(t)
                a = end
        t = np.unique(np.concatenate(all_t)) if all_t else np.zeros(0, np.int32)
        return t, best[t], at[t], tree

    def ask(self, q: np.ndarray, hits: tuple, no, yes, named: np.ndarray | None, limit: int) -> Asked:
        """Seeds are the best hits, then what the query names, as ``seeds`` has them by its default rules."""
        first, cosine = hits[0][: self.seed_k], hits[1][: self.seed_k]
        if named is not None and len(named):
            more = named[np.sort(np.unique(named, return_index=True)[1])]
            more = more[~np.isin(more, first)]
            first, cosine = np.concatenate([first, more]), np.concatenate([cosine, self.cosine(q, more)])
        fronts = self.fronts(first, np.clip((cosine + 1) / 2, 0.0, 1.0))
        return Asked(q, hits, no, yes, fronts, self.emitted(fronts, limit))

    def emitted(self, fronts, limit: int):
        """(front, candidate, score, relation, rank) of the ``limit`` best paths of each candidate."""
        h = self.h
        score, depth, node, path, rel = fronts
        value = score * self.decay[depth]
        place = np.empty(len(node), np.int64)
        place[np.lexsort((*rel.T[::-1], *path.T[::-1]))] = np.arange(len(node))
        length = (path >= 0).sum(1)
        if isinstance(h.links.w, float):
            value = value * h.links.w
            by = np.lexsort((place, -value))
            from_, at = h.links.of_keys(node[by])
            from_ = by[from_]
            s = value[from_]
            mixed = bool(((value[by][1:] == value[by][:-1]) & (length[by][1:] != length[by][:-1])).any())
        else:
            from_, at = h.links.of_keys(node)
            s = value[from_] * h.links.w[at]
            by = np.lexsort((h.links.rel[at], place[from_], -s))
            from_, at, s = from_[by], at[by], s[by]
            mixed = bool(((s[1:] == s[:-1]) & (length[from_][1:] != length[from_][:-1])).any())
        c = h.links.to[at]
        if mixed:  # a path may begin another one: whole paths decide, with the candidate at the end
            whole, last = self.whole(path[from_], rel[from_], c, h.links.rel[at])
            by = np.lexsort((*last.T[::-1], *whole.T[::-1], -s))
            from_, at, s, c = from_[by], at[by], s[by], c[by]
        left, out, ranks = np.arange(len(c)), [], []
        for k in range(limit):
            first = self._first(c[left])
            out.append(left[first])
            ranks.append(np.full(len(out[-1]), k + 1, np.int32))
            left = left[~first]
            if not len(left):
                break
        one = np.concatenate(out)
        return from_[one], c[one], s[one], h.links.rel[at[one]], np.concatenate(ranks)

    def whole(self, path: np.ndarray, rel: np.ndarray, c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths and relations with the last step to the candidate."""
        return _longer(path, rel, self.h.own[c], r)


def aggregated(c: np.ndarray, s: np.ndarray, rank: np.ndarray, how: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, graph score, best) of the best paths of each candidate, the first paths first."""
    one = c[rank == 1]
    clip = np.clip(s, 0.0, 1.0)
    if how == "max":
        return one, clip[rank == 1], s[rank == 1]
    at = np.zeros(size, np.int32)
    at[one] = np.arange(len(one))
    if how == "sum":
        return one, np.minimum(1.0, np.bincount(at[c], clip, len(one))), s[rank == 1]
    rest = np.ones(len(one))
    for k in range(int(rank.max(initial=0)), 0, -1):  # the least first, as in ``graph_scores``
        rest[at[c[rank == k]]] *= 1 - clip[rank == k]
    return one, 1 - rest, s[rank == 1]


def distinct_in_rows(a: np.ndarray) -> np.ndarray:
    """Number of different values of each row; negative ones don't count."""
    s = np.sort(a, 1)
    return ((s[:, 1:] != s[:, :-1]) & (s[:, 1:] >= 0)).sum(1) + (s[:, 0] >= 0) if s.shape[1] else np.zeros(len(s), int)


# ---- Results ----------------------------------------------------------------------------------------------------------


@dataclass
class Asked:
    """What a query's run makes: its vector, hits, fronts and best paths."""

    vector: np.ndarray  # of length one
    hits: tuple[np.ndarray, np.ndarray]
    no: np.ndarray | None
    yes: np.ndarray | None
    fronts: tuple
    best: tuple


@dataclass(frozen=True)
class Paths:
    """All best paths, as joined names: (query_id, candidate_id, path_rank, score, path and, if asked for, relations)."""

    limit: int
    digits: int | None = None
    relations: bool = True

    @property
    def schema(self) -> str:
        return "query_id string, candidate_id string, path_rank int, score double, path string" + ", relations string" * self.relations

    def __call__(self, w: Walker, a: Asked, _) -> tuple[int, list]:
        h, (_, _, _, path, rel), (front, c, s, r, rank) = w.h, a.fronts, a.best
        joined = lambda names, codes: pc.binary_join_element_wise(*(names.take(pa.array(v, mask=v < 0)) for v in codes.T), "|", null_handling="skip")
        ends = lambda names, codes, last: pc.binary_join_element_wise(joined(names, codes).take(pa.array(front)), names.take(pa.array(last)), "|")
        out = [h.ids.take(pa.array(c)), pa.array(rank), pa.array(shown(s, self.digits)), ends(h.names, path, h.own[c])]
        return len(c), [*out, ends(h.relations, rel, r)] if self.relations else out


@dataclass(frozen=True)
class Scores:
    """(query_id, candidate_id, graph_score, best)."""

    limit: int
    how: str
    digits: int | None = None
    schema = "query_id string, candidate_id string, graph_score double, best double"

    def __call__(self, w: Walker, a: Asked, _) -> tuple[int, list]:
        c, g, best = aggregated(a.best[1], a.best[2], a.best[4], self.how, len(w.h.ids))
        return len(c), [w.h.ids.take(pa.array(c)), pa.array(shown(g, self.digits)), pa.array(best)]


def pooled(w: Walker, a: Asked) -> tuple[np.ndarray, ...]:
    """(candidate, semantic score, graph score, by search, by graph), as ``pool`` makes them."""
    e = w.e
    c, g, best = aggregated(a.best[1], a.best[2], a.best[4], e.aggregation, len(w.h.ids))
    score = np.zeros(len(w.h.ids))
    score[c] = g
    entering = c[np.lexsort((c, -best))[: e.graph_candidates]]
    hits, cosine = a.hits
    only = np.setdiff1d(entering, hits)
    if a.no is not None:
        only = np.setdiff1d(only, a.no)
    if a.yes is not None:
        only = np.intersect1d(only, a.yes)
    every = np.concatenate([hits, only])
    cosine = np.concatenate([cosine, w.cosine(a.vector, only)])
    by_search = np.arange(len(every)) < len(hits)
    return every, np.clip((cosine + 1) / 2, 0.0, 1.0), score[every], by_search, np.isin(every, entering)


@dataclass(frozen=True)
class Pool:
    """(query_id, candidate_id, semantic_score, graph_score, by_search, by_graph); digits: of the two scores."""

    limit: int
    digits: tuple[int | None, int | None] = (None, None)
    schema = "query_id string, candidate_id string, semantic_score double, graph_score double, by_search boolean, by_graph boolean"

    def __call__(self, w: Walker, a: Asked, _) -> tuple[int, list]:
        c, semantic, graph, *by = pooled(w, a)
        return len(c), [w.h.ids.take(pa.array(c)), pa.array(shown(semantic, self.digits[0])), pa.array(shown(graph, self.digits[1])), *map(pa.array, by)]


@dataclass(frozen=True)
class Counts:
    """(query_id, pool_size, semantic, graph_only) of queries with a pool."""

    limit: int
    schema = "query_id string, pool_size long, semantic long, graph_only long"

    def __call__(self, w: Walker, a: Asked, _) -> tuple[int, list]:
        c, _, _, s, g = pooled(w, a)
        return int(len(c) > 0), [pa.array([v] * int(len(c) > 0), pa.int64()) for v in (len(c), int(s.sum()), int((g & ~s).sum()))]


@dataclass(frozen=True)
class Ranked:
    """The ``k`` best by fused score with the sizes of their evidence, and ``paths``: their paths.

    ``model``: (features, scores) of a query's ranked candidates to new scores; the ``kept`` best by these instead, as
    (query_id, candidate_id, neural_score, neural_rank).
    """

    limit: int
    k: int
    ws: float
    wg: float
    paths: bool = False
    model: Callable | None = None
    kept: int = 0

    @property
    def schema(self) -> str:
        if self.model:
            return "query_id string, candidate_id string, neural_score double, neural_rank int"
        return "query_id string, candidate_id string, semantic_score double, graph_score double, by_search boolean, by_graph boolean, score double, rank int, node_count long, edge_count long, path_count long, best_path_hops int" + ", paths array<array<string>>, relations array<array<string>>" * self.paths

    def __call__(self, w: Walker, a: Asked, raw: np.ndarray) -> tuple[int, list]:
        h, (c, semantic, graph, s, g) = w.h, pooled(w, a)
        fused = (semantic * self.ws + graph * self.wg) / (self.ws + self.wg)
        by = np.lexsort((c, -fused))[: self.k]
        c, semantic, graph, s, g, fused = (v[by] for v in (c, semantic, graph, s, g, fused))
        n, place = len(c), np.full(len(h.ids), -1, np.int64)
        place[c] = np.arange(n)
        front, end, _, r, rank = a.best
        mine = np.flatnonzero(place[end] >= 0)
        mine = mine[np.lexsort((rank[mine], place[end[mine]]))]
        of = place[end[mine]]
        path, rel = w.whole(a.fronts[3][front[mine]], a.fronts[4][front[mine]], end[mine], r[mine])
        # Nodes and edges of a candidate's paths side by side.
        width, nodes = path.shape[1], np.full((n, self.limit * path.shape[1]), -1, np.int64)
        edges = np.full((n, self.limit * rel.shape[1]), -1, np.int64)
        slot = (rank[mine] - 1).astype(np.int64)
        nodes[of[:, None], slot[:, None] * width + np.arange(width)] = path
        edge = (path[:, :-1].astype(np.int64) * len(h.names) + path[:, 1:]) * max(1, len(h.relations)) + rel
        edges[of[:, None], slot[:, None] * (width - 1) + np.arange(width - 1)] = np.where(rel >= 0, edge, -1)
        length = (path >= 0).sum(1)
        hops = np.zeros(n, np.int32)
        hops[of[slot == 0]] = length[slot == 0] - 1
        counts = [distinct_in_rows(nodes), distinct_in_rows(edges), np.bincount(of, minlength=n)]
        ids = h.ids.take(pa.array(c))
        if self.model:
            numbers = np.stack([semantic, graph, fused, np.log1p(counts[0]) / 5, np.log1p(counts[1]) / 5, np.log1p(counts[2]) / 3, hops / 10], 1)
            x = h.raw[c]
            q = np.broadcast_to(raw, x.shape)
            score = self.model(np.concatenate([q, x, q * x, np.abs(q - x), numbers], 1), fused) if n else np.zeros(0)
            top = np.lexsort((c, -score))[: self.kept]
            return len(top), [ids.take(pa.array(top)), pa.array(score[top]), pa.array(np.arange(1, len(top) + 1, dtype=np.int32))]
        out = [ids, pa.array(semantic), pa.array(graph), pa.array(s), pa.array(g), pa.array(fused), pa.array(np.arange(1, n + 1, dtype=np.int32)), *(pa.array(v.astype(np.int64)) for v in counts), pa.array(hops)]
        if self.paths:
            outer = np.concatenate([[0], np.cumsum(counts[2])]).astype(np.int32)
            for names, codes in ((h.names, path), (h.relations, rel)):
                inner = np.concatenate([[0], np.cumsum((codes >= 0).sum(1))]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), names.take(pa.array(codes[codes >= 0])))))
        return n, out


def run(held, e: Expansion, k: int, seed_k: int, in_order: bool, make):
    """Arrow batches of queries (query_id, vector, excluded, allowed, named) to what ``make`` has; held: a broadcast of it, packed."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, parts, rows = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            w = w or Walker(held.value.open(), e, k, seed_k, in_order)
            unit, ids = _unit(batch.column("vector")), batch.column("query_id")
            raw = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(unit.shape)
            no, yes, named = (_lists(batch.column(c), w.h.ids) for c in ("excluded", "allowed", "named"))
            for a in range(0, len(unit), QUERIES):
                part = slice(a, a + QUERIES)
                for i, hits in enumerate(w.search(unit[part], no[part], yes[part]), a):
                    n, columns = make(w, w.ask(unit[i], hits, no[i], yes[i], named[i], make.limit), raw[i])
                    if n:
                        parts.append([pa.repeat(ids[i], n), *columns])
                        rows += n
                    if rows >= OUT_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], names=names)
                        parts, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], names=names)

    names = [c.split()[0] for c in re.sub(r"<[^,]*>", "", make.schema).split(", ")]
    return walk
