"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node, so a very common vector costs nothing; of its rows
the k + 1 smallest ids are kept, as no more can be among anyone's k nearest. The
graph, too, is by inner product, so that where norms differ, lists lead to the
long vectors that are the answers; a long vector may be on very many lists.

Nodes are dealt out in bundles by a hash of their key. All work is done in
supersteps (packets.py), of one exchange each: a bundle gets its messages and
the parts of its graph that the step needs, and returns new messages. A bundle
sends another a vector once, however many of its nodes asked for it.

The graph starts from a few random partitions into cells of CELL nodes, a small
multiple of K. In a round of NN-descent

1. every node tells its neighbours that it lists them (LISTED);
2. a node's candidates are its neighbours and a sample of REVERSE of those that
   list it; if any is new to the list that it was on, their vectors are asked
   for (WANT);
3. these are given (GIVEN), with the least similarity that their lists hold;
4. candidates are joined pair by pair, if one of the pair is new, and each is
   offered the best of the others, if better than what its list has (OFFER);
   lists take the best K.

Rounds go on until one changes hardly any entry (SETTLED).

A query keeps a beam of the best nodes seen, at first its own neighbours and the
best of 2 * ENTRIES entries that all queries share. In a round

1. it expands its best unexpanded ones: their lists are asked for (ASK), each
   once a bundle of queries, and given (LISTS);
2. the nodes on them go to be scored (SCORE), each once for each query, and with
   the query's direction once for each bundle;
3. those better than the worst of its beam come back (OFFER).

The search ends when no beam holds an unexpanded node. Scores that are returned
are computed again from the original vectors in double precision.

Nothing is gathered per node or query beyond the bounded beam and lists.

Defined results: vectors that are null, zero, or hold a null or non-finite
component take no part, as queries or otherwise. Where lengths differ, the
shorter of two vectors is read as if it went on with zeros. Rows that repeat
both an id and a vector are one candidate, rows that share an id only are
separate ones; a query never returns its own id. Queries that share an id are
answered each. Ties go to the smaller id. With fewer candidates than asked for,
all that are found are returned. Empty tables give empty results. Columns other
than id and vector are ignored. Scores beyond a double are infinite.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .packets import PARTS, ROW, Inbox, row, send, superstep, table, write
from .store import Scratch

K, REVERSE, PROPOSE = 40, 32, 8
CELL, PARTITIONS = 128, 4
#: NN-descent ends with a round that changes no more than this share of all list entries.
SETTLED = 0.01
#: Nodes of a bundle, about, at up to BUNDLE_NUMBERS / BUNDLE components; fewer for longer vectors.
BUNDLE, BUNDLE_NUMBERS = 4096, 1 << 19
#: The beam at up to BEAM_NODES nodes, beyond which it grows with their square root; half of it is expanded in a round.
BEAM, BEAM_NODES = 160, 1 << 15
#: Entries of the search: so many of the longest vectors, and so many that their hash picks.
ENTRIES = 64
#: Lists joined at once.
LISTS_AT_ONCE = 256
#: Pairs scored at once, whose vectors a core's cache holds.
PAIRS_AT_ONCE = 1 << 11
GRAPH, CELLS, OFFER, LISTED, WANT, GIVEN, JOIN, QUERY, BEAMS, OPEN, ASK, LISTS, SCORE = range(13)


def bundle_of(ids: np.ndarray, bundles: int) -> np.ndarray:
    return (tokens.mix(ids.view(tokens.U64).copy()) & tokens.U64(bundles - 1)).astype(np.int64)


def _row(bundle: int, kind: int, *parts: np.ndarray, source: int = 0, count: int = 0) -> tuple:
    return row(bundle, kind, len(parts[0]), *parts, source=source, count=count)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, which are the first of their kind."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    changed = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        changed |= k[1:] != k[:-1]
    return np.r_[True, changed]


def _rank(group: np.ndarray) -> np.ndarray:
    """Place of each row in its group; rows are sorted by group."""
    start = np.flatnonzero(_first_of(group))
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))


def _pairs(place: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One number for each place (of at most 2 ** 20) and key; they sort by place."""
    return place.astype(tokens.U64) << tokens.U64(44) | tokens.mix(ids.view(tokens.U64).copy()) >> tokens.U64(20)


def _best_first(place: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """One number for each place and similarity; they sort by place, then best first."""
    bits = (sims.astype(np.float32) + np.float32(0)).view(np.uint32)
    falling = np.where(bits >> 31 == 1, bits, ~bits & np.uint32(0x7FFFFFFF))
    return place.astype(tokens.U64) << tokens.U64(32) | falling.astype(tokens.U64)


def _once(place: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of rows equal in place and key the first, in the order of places."""
    key = _pairs(place, ids)
    order = np.argsort(key, kind="stable")
    return order[_first_of(key[order])]


def _sampled(most: int, salt: int, by: np.ndarray, listed: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """At most so many rows of each listed key, new and old ones apart, chosen by a hash."""
    group = tokens.mix(listed.view(tokens.U64) + fresh.astype(tokens.U64)) >> tokens.U64(24)
    order = np.argsort(group << tokens.U64(24) | tokens.mix(by.view(tokens.U64) + tokens.U64(salt)) >> tokens.U64(40))
    start = np.flatnonzero(_first_of(group[order]))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < most]


class Graph:
    """The nodes of a bundle, sorted by key: directions and norms; neighbours, nearest first (their own key where there is none), with similarities and whether they are new.

    A step is sent the parts that it needs; the others are empty.
    """

    def __init__(self, ids: np.ndarray, dirs: np.ndarray, norms: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, fresh: np.ndarray):
        self.ids, self.dirs, self.norms, self.nbrs, self.sims, self.fresh = ids, dirs, norms, nbrs, sims, fresh

    @staticmethod
    def of(inbox: Inbox, d: int) -> Graph | None:
        """The graph of a bundle, if it has nodes."""
        if GRAPH not in inbox.rows:
            return None
        return Graph(inbox.of(GRAPH, "a", np.int64), inbox.of(GRAPH, "b", np.float16, d), inbox.of(GRAPH, "c", np.float32), inbox.of(GRAPH, "d", np.int64, K), inbox.of(GRAPH, "e", np.float32, K), inbox.of(GRAPH, "f", bool, K))

    @staticmethod
    def empty(ids: np.ndarray, dirs: np.ndarray, norms: np.ndarray) -> Graph:
        return Graph(ids, dirs, norms, np.repeat(ids[:, None], K, 1), np.full((len(ids), K), -np.inf, np.float32), np.zeros((len(ids), K), bool))

    def row(self, bundle: int, changed: int = 0) -> tuple:
        return _row(bundle, GRAPH, self.ids, self.dirs, self.norms, self.nbrs, self.sims, self.fresh, count=changed)

    def places(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each node, key of its neighbour and whether that is new, for all neighbours."""
        own = self.nbrs != self.ids[:, None]
        return np.repeat(np.arange(len(self.ids)), own.sum(1)), self.nbrs[own], self.fresh[own]

    def offered(self, to: np.ndarray, offered: np.ndarray, sims: np.ndarray) -> tuple[Graph, int]:
        """With the best K of the neighbours so far and those offered; and how many of these are new."""
        place, near, old = self.edges()
        n = len(near)
        a, b = np.concatenate([place, self.places(to)]), np.concatenate([near, offered])
        x = np.concatenate([self.sims[self.nbrs != self.ids[:, None]], sims])
        fresh, come = np.concatenate([old, np.ones(len(to), bool)]), np.arange(len(a)) >= n
        keep = b != self.ids[a]
        a, b, x, fresh, come = a[keep], b[keep], x[keep], fresh[keep], come[keep]
        order = _once(a, b)  # those that are there come first
        order = order[np.argsort(_best_first(a[order], x[order]), kind="stable")]
        a, b, x, fresh, come = a[order], b[order], x[order], fresh[order], come[order]
        rank = _rank(a)
        best = rank < K
        out = Graph.empty(self.ids, self.dirs, self.norms)
        at = a[best], rank[best]
        out.nbrs[at], out.sims[at], out.fresh[at] = b[best], x[best], fresh[best]
        return out, int(come[best].sum())


def _directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and norms."""
    top = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / top
    norms = np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return scaled / norms, (top * norms)[:, 0]


def _packed(bundles: int, d: int, largest: float):
    """Nodes (node, v) as pieces of graphs without edges, one for each bundle and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d)
            dirs, norms = _directions(vectors / largest)
            yield from table(send(GRAPH, bundle_of(ids, bundles), ids, dirs.astype(np.float16), norms.astype(np.float32))).to_batches()

    return run


def _scatter(bundles: int, d: int, bits: int):
    """Packs a bundle's nodes, and sends each to a cell of every partition: the side of each of some random hyperplanes.

    Where several of the bundle's nodes meet in a cell it is large, as bundles
    are random samples, and is dealt out over several bundles.
    """

    def run(inbox: Inbox) -> list[tuple]:
        ids = inbox.of(GRAPH, "a", np.int64)
        order = np.argsort(ids)
        graph = Graph.empty(ids[order], inbox.of(GRAPH, "b", np.float16, d)[order], inbox.of(GRAPH, "c", np.float32)[order])
        out = [graph.row(inbox.bundle)]
        for p in range(PARTITIONS):
            planes = np.random.default_rng(1000 + p).normal(size=(d, max(bits, 1))).astype(np.float32)
            side = ((graph.dirs.astype(np.float32) @ planes > 0) @ (1 << np.arange(max(bits, 1)))).astype(np.int64) if bits else np.zeros(len(ids), np.int64)
            _, of, size = np.unique(side, return_inverse=True, return_counts=True)
            shares = np.where(size > 1, -(-size * bundles // BUNDLE), 1)[of]
            share = (tokens.mix(graph.ids.view(tokens.U64) + tokens.U64(p)) % shares.astype(tokens.U64)).astype(np.int64)
            cell = tokens.mix((side * PARTITIONS + p).view(tokens.U64) ^ (share.view(tokens.U64) << tokens.U64(48))).view(np.int64)
            out += send(CELLS, bundle_of(cell, bundles), graph.ids, graph.dirs, graph.norms, cell)
        return out

    return run


def _join_cells(bundles: int, d: int):
    """Offers each node the best of its cells; a cell of more than CELL nodes is cut in parts, in the order of a hash."""

    def run(inbox: Inbox) -> list[tuple]:
        out = inbox.kept(GRAPH)
        ids, dirs, norms, cell = inbox.of(CELLS, "a", np.int64), inbox.of(CELLS, "b", np.float16, d), inbox.of(CELLS, "c", np.float32), inbox.of(CELLS, "d", np.int64)
        order = np.lexsort((tokens.mix(ids.view(tokens.U64).copy()), cell))
        ids, dirs, norms, cell = ids[order], dirs[order], norms[order], cell[order]
        start = np.flatnonzero(_first_of(cell) | (_rank(cell) % CELL == 0))
        to, offered, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for low, high in zip(start, np.r_[start[1:], len(ids)], strict=True):
            n = min(K, high - low - 1)
            if n < 1:
                continue
            own = dirs[low:high].astype(np.float32)
            x = own @ own.T * norms[low:high]
            np.fill_diagonal(x, -np.inf)
            best = np.argpartition(-x, n - 1, axis=1)[:, :n]
            to.append(np.repeat(ids[low:high], n))
            offered.append(ids[low:high][best].ravel())
            sims.append(np.take_along_axis(x, best, 1).ravel())
        to, offered, sims = np.concatenate(to), np.concatenate(offered), np.concatenate(sims)
        return out + send(OFFER, bundle_of(to, bundles), to, offered, sims)

    return run


def _take(bundles: int, d: int, salt: int):
    """Lists take what is offered; every node tells its neighbours that it lists them, at most REVERSE of a bundle each."""

    def run(inbox: Inbox) -> list[tuple]:
        graph = Graph.of(inbox, d)
        if graph is None:
            return []
        graph.fresh = np.zeros(graph.nbrs.shape, bool)
        graph, changed = graph.offered(inbox.of(OFFER, "a", np.int64), inbox.of(OFFER, "b", np.int64), inbox.of(OFFER, "c", np.float32))
        place, near, fresh = graph.edges()
        by = graph.ids[place]
        some = _sampled(REVERSE, salt, by, near, fresh)
        return [graph.row(inbox.bundle, changed), *send(LISTED, bundle_of(near[some], bundles), near[some], by[some], fresh[some])]

    return run


def _candidates(bundles: int, d: int, salt: int):
    """Asks for the vectors of all candidates of nodes that have a new one."""

    def run(inbox: Inbox) -> list[tuple]:
        graph = Graph.of(inbox, d)
        if graph is None:
            return []
        place, near, fresh = graph.edges()
        listed, by, new = inbox.of(LISTED, "a", np.int64), inbox.of(LISTED, "b", np.int64), inbox.of(LISTED, "c", bool)
        some = _sampled(REVERSE, salt, by, listed, new)
        place, near, fresh = np.concatenate([place, graph.places(listed[some])]), np.concatenate([near, by[some]]), np.concatenate([fresh, new[some]])
        order = np.argsort(~fresh, kind="stable")
        order = order[_once(place[order], near[order])]
        place, near, fresh = place[order], near[order], fresh[order]
        active = (np.bincount(place, fresh, len(graph.ids)) > 0)[place]
        place, near, fresh = place[active], near[active], fresh[active]
        wanted = np.unique(near)
        return [_row(inbox.bundle, JOIN, place.astype(np.int32), near, fresh), *send(WANT, bundle_of(wanted, bundles), wanted, source=inbox.bundle)]

    return run


def _give(d: int):
    def run(inbox: Inbox) -> list[tuple]:
        graph = Graph.of(inbox, d)
        if graph is None:
            return []
        out = inbox.kept(JOIN)
        for r in inbox.rows.get(WANT, ()):
            ids = np.frombuffer(r["a"], np.int64)
            at = graph.places(ids)
            out.append(_row(r["source"], GIVEN, ids, graph.dirs[at], graph.norms[at], graph.sims[at, -1]))
        return out

    return run


def _join(bundles: int, d: int):
    """Joins the candidates of each node pair by pair and offers to each the best of the others."""

    def run(inbox: Inbox) -> list[tuple]:
        if GIVEN not in inbox.rows:
            return []
        place, near, fresh = inbox.of(JOIN, "a", np.int32), inbox.of(JOIN, "b", np.int64), inbox.of(JOIN, "c", bool)
        ids, dirs, norms, worst = inbox.of(GIVEN, "a", np.int64), inbox.of(GIVEN, "b", np.float16, d), inbox.of(GIVEN, "c", np.float32), inbox.of(GIVEN, "d", np.float32)
        by_id = np.argsort(ids)
        at = by_id[np.searchsorted(ids[by_id], near)]  # of each candidate, its vector
        start = np.flatnonzero(_first_of(place))
        size = np.diff(np.r_[start, len(place)])
        to, offered, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for low in range(0, len(start), LISTS_AT_ONCE):
            s, n = start[low : low + LISTS_AT_ONCE], size[low : low + LISTS_AT_ONCE]
            width = int(n.max())
            row = np.minimum(s[:, None] + np.arange(width), len(place) - 1)
            real = np.arange(width) < n[:, None]
            which = at[row]
            own = dirs[which].astype(np.float32)
            x = own @ own.transpose(0, 2, 1) * norms[which][:, None, :]
            new = fresh[row] & real
            good = (new[:, :, None] | new[:, None, :]) & real[:, :, None] & real[:, None, :] & (x > worst[which][:, :, None])
            good[:, np.arange(width), np.arange(width)] = False
            if good.sum() <= PROPOSE * real.sum():
                i, j, k = np.nonzero(good)
            else:
                x[~good] = -np.inf
                m = min(PROPOSE, width)
                best = np.argpartition(-x, m - 1, axis=2)[:, :, :m]
                i, j, k = np.nonzero(np.isfinite(np.take_along_axis(x, best, 2)))
                k = best[i, j, k]
            to.append(which[i, j])
            offered.append(which[i, k])
            sims.append(x[i, j, k])
        to, offered, sims = np.concatenate(to), np.concatenate(offered), np.concatenate(sims)
        _, once = np.unique(to * len(ids) + offered, return_index=True)
        to, offered, sims = to[once], offered[once], sims[once]
        some = np.argsort(_best_first(to, sims), kind="stable")
        some = some[_rank(to[some]) < K]
        to, offered, sims = ids[to[some]], ids[offered[some]], sims[some]
        return send(OFFER, bundle_of(to, bundles), to, offered, sims)

    return run


def _only(graph: DataFrame, *parts: str) -> DataFrame:
    """Rows with some of their parts; the others aren't read."""
    return graph.withColumns({p: F.lit(b"") for p in PARTS if p not in parts})


def bundles_for(count: int, d: int) -> int:
    return 1 << max(0, count // max(256, min(BUNDLE, BUNDLE_NUMBERS // d))).bit_length()


def beam_for(count: int, k: int) -> int:
    return max(math.ceil(BEAM * max(1.0, count / BEAM_NODES) ** 0.5), 4 * k)


def build(nodes: DataFrame, d: int, count: int, largest: float, scratch: Scratch, rounds: int | None = None) -> DataFrame:
    """The graph of nodes (node, v: d doubles of at most largest), of each bundle one row with directions and norms and one with the rest.

    rounds: so many rounds of NN-descent, instead of until it settles.
    """
    bundles = bundles_for(count, d)
    state = superstep(nodes.mapInArrow(_packed(bundles, d, largest), ROW), _scatter(bundles, d, (count // CELL).bit_length() - 1 if count >= 2 * CELL else 0))
    state = write(scratch, superstep(superstep(state, _join_cells(bundles, d)), _take(bundles, d, 0)), "graph/0")
    directions = _only(state(GRAPH), "b", "c")
    i, changed = 0, K * count
    while changed > SETTLED * K * count if rounds is None else i < rounds:
        # What a step doesn't need of the graph isn't sent to it; directions are written once.
        wants = superstep(_only(state(GRAPH), "a", "d", "f").union(state(LISTED)), _candidates(bundles, d, i))
        given = superstep(wants.union(directions).union(_only(state(GRAPH), "a", "e")), _give(d))
        offers = superstep(given, _join(bundles, d))
        i += 1
        state = write(scratch, superstep(offers.union(_only(state(GRAPH), "a", "d", "e")), _take(bundles, d, i)), f"graph/{i}")
        if i > 1:
            scratch.drop(f"graph/{i - 1}")
        changed = state(GRAPH).agg(F.sum("count")).first()[0] or 0
    return directions.union(_only(state(GRAPH), "a", "d", "e", "f"))


def _asked(bundles: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            yield from table(send(QUERY, bundle_of(ids, bundles), ids)).to_batches()

    return run


class Beams:
    """Of the queries of a bundle, by key: their directions; the best nodes seen, best first (-1 where there is none), their similarities and whether they have been expanded."""

    def __init__(self, ids: np.ndarray, dirs: np.ndarray, nodes: np.ndarray, sims: np.ndarray, done: np.ndarray):
        self.ids, self.dirs, self.nodes, self.sims, self.done = ids, dirs, nodes, sims, done

    @staticmethod
    def of(inbox: Inbox, d: int, width: int) -> Beams:
        return Beams(inbox.of(BEAMS, "a", np.int64), inbox.of(BEAMS, "b", np.float16, d), inbox.of(BEAMS, "c", np.int64, width), inbox.of(BEAMS, "d", np.float32, width), inbox.of(BEAMS, "e", bool, width))

    @staticmethod
    def started(ids: np.ndarray, graph: Graph, entries: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> Beams:
        """With each query's own node, its neighbours and the entries."""
        at = graph.places(ids)
        beams = Beams(ids, graph.dirs[at], np.full((len(ids), width), -1, np.int64), np.full((len(ids), width), -np.inf, np.float32), np.zeros((len(ids), width), bool))
        entry_ids, dirs, norms = entries
        near = beams.dirs.astype(np.float32) @ dirs.T * norms
        q, k = np.nonzero(graph.nbrs[at] != ids[:, None])
        every = np.arange(len(ids))
        query = np.concatenate([every, q, np.repeat(every, len(entry_ids))])
        node = np.concatenate([ids, graph.nbrs[at][q, k], np.tile(entry_ids, len(ids))])
        return beams.taken(query, node, np.concatenate([graph.norms[at], graph.sims[at][q, k], near.ravel()]))

    def open(self) -> np.ndarray:
        """The best unexpanded places of each beam."""
        ready = ~self.done & (self.nodes != -1)
        return ready & (np.cumsum(ready, 1) <= max(1, self.nodes.shape[1] // 2))

    def taken(self, query: np.ndarray, node: np.ndarray, sims: np.ndarray) -> Beams:
        """With the scored nodes; query: places of queries. A query's own node counts as expanded."""
        q, k = np.nonzero(self.nodes != -1)
        query, node, sims = np.concatenate([q, query]), np.concatenate([self.nodes[q, k], node]), np.concatenate([self.sims[q, k], sims]).astype(np.float32)
        done = np.concatenate([self.done[q, k], np.zeros(len(query) - len(q), bool)]) | (node == self.ids[query])
        order = np.argsort(~done, kind="stable")
        order = order[_once(query[order], node[order])]
        order = order[np.argsort(_best_first(query[order], sims[order]), kind="stable")]
        query, node, sims, done = query[order], node[order], sims[order], done[order]
        rank = _rank(query)
        some = rank < self.nodes.shape[1]
        out = Beams(self.ids, self.dirs, np.full_like(self.nodes, -1), np.full_like(self.sims, -np.inf), np.zeros_like(self.done))
        at = query[some], rank[some]
        out.nodes[at], out.sims[at], out.done[at] = node[some], sims[some], done[some]
        return out


def _opened(beams: Beams, bundle: int, bundles: int) -> list[tuple]:
    """Beams, whose best unexpanded nodes are now expanded: their lists are asked for, each once a bundle."""
    now = beams.open()
    beams.done |= now
    q, k = np.nonzero(now)
    node = beams.nodes[q, k]
    wanted = np.unique(node)
    return [
        _row(bundle, BEAMS, beams.ids, beams.dirs, beams.nodes, beams.sims, beams.done, count=len(node)),
        _row(bundle, OPEN, beams.ids, beams.dirs, beams.sims[:, -1], q.astype(np.int32), node),
        *send(ASK, bundle_of(wanted, bundles), wanted, source=bundle),
    ]


def _start(bundles: int, d: int, width: int, entries):
    def run(inbox: Inbox) -> list[tuple]:
        if QUERY not in inbox.rows:
            return []
        return _opened(Beams.started(np.unique(inbox.of(QUERY, "a", np.int64)), Graph.of(inbox, d), entries, width), inbox.bundle, bundles)

    return run


def _advance(bundles: int, d: int, width: int):
    """Beams take what was scored."""

    def run(inbox: Inbox) -> list[tuple]:
        beams = Beams.of(inbox, d, width)
        return _opened(beams.taken(np.searchsorted(beams.ids, inbox.of(OFFER, "a", np.int64)), inbox.of(OFFER, "b", np.int64), inbox.of(OFFER, "c", np.float32)), inbox.bundle, bundles)

    return run


def _list(inbox: Inbox) -> list[tuple]:
    """Returns the lists of nodes that are asked for."""
    out, own = [], inbox.of(GRAPH, "a", np.int64)
    nbrs = inbox.of(GRAPH, "d", np.int64, K)
    for r in inbox.rows.get(ASK, ()):
        ids = np.frombuffer(r["a"], np.int64)
        out.append(_row(r["source"], LISTS, ids, nbrs[np.searchsorted(own, ids)]))
    return out


def _spread(bundles: int, d: int):
    """Sends a query, once to each bundle, the nodes on the lists of those it has opened: each node of a message with the queries that it is to be scored for, as places in the message."""

    def run(inbox: Inbox) -> list[tuple]:
        if LISTS not in inbox.rows:
            return []
        out = []
        queries, dirs, worst = inbox.of(OPEN, "a", np.int64), inbox.of(OPEN, "b", np.float16, d), inbox.of(OPEN, "c", np.float32)
        query, node = inbox.of(OPEN, "d", np.int32), inbox.of(OPEN, "e", np.int64)
        listed, lists = inbox.of(LISTS, "a", np.int64), inbox.of(LISTS, "b", np.int64, K)
        near, place = np.unique(lists, return_inverse=True)
        dest = bundle_of(near, bundles)
        order = np.argsort(dest, kind="stable")
        near, dest = near[order], dest[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lists = rank[place].reshape(-1, K)
        by_id = np.argsort(listed)
        # One number for each pair of a node, in the order of its bundle, and a query; plain numbers sort fast.
        pair = lists[by_id[np.searchsorted(listed[by_id], node)]] << 32 | query[:, None]
        pair = np.sort(pair, axis=None)
        pair = pair[_first_of(pair)]
        node, query = pair >> 32, pair & 0xFFFFFFFF
        start = np.flatnonzero(_first_of(dest))
        cut = np.searchsorted(node, np.r_[start, len(near)])
        place = np.zeros(len(queries), np.int32)
        for bundle, low, high in zip(dest[start], cut[:-1], cut[1:], strict=True):
            own = np.zeros(len(queries), bool)
            own[query[low:high]] = True
            own = np.flatnonzero(own)
            place[own] = np.arange(len(own))
            first = np.flatnonzero(_first_of(node[low:high]))
            size = np.diff(np.r_[first, high - low]).astype(np.int32)
            out.append(_row(bundle, SCORE, near[node[low:high][first]], size, place[query[low:high]], queries[own], dirs[own], worst[own], source=inbox.bundle))
        return out

    return run


def _rate(d: int):
    """Scores nodes of a bundle for queries; returns those that are better than what the beams hold."""

    def run(inbox: Inbox) -> list[tuple]:
        if SCORE not in inbox.rows:
            return []
        out, nodes = [], inbox.of(GRAPH, "a", np.int64)
        own = inbox.of(GRAPH, "b", np.float16, d).astype(np.float32) * inbox.of(GRAPH, "c", np.float32)[:, None]
        for r in inbox.rows[SCORE]:
            ids, size, of = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int32), np.frombuffer(r["c"], np.int32)
            queries, dirs, worst = np.frombuffer(r["d"], np.int64), np.frombuffer(r["e"], np.float16).reshape(-1, d).astype(np.float32), np.frombuffer(r["f"], np.float32)
            at = np.repeat(np.searchsorted(nodes, ids), size)
            sims = np.empty(len(of), np.float32)
            for low in range(0, len(of), PAIRS_AT_ONCE):
                s = slice(low, low + PAIRS_AT_ONCE)
                np.einsum("ij,ij->i", own[at[s]], dirs[of[s]], out=sims[s])
            good = np.flatnonzero(sims > worst[of])
            if len(good):
                out.append(_row(r["source"], OFFER, queries[of[good]], nodes[at[good]], sims[good]))
        return out

    return run


def _found(most: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, nodes = np.frombuffer(r["a"], np.int64), np.frombuffer(r["c"], np.int64).reshape(-1, width)[:, :most]
                q, k = np.nonzero(nodes != -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(nodes[q, k])], ["query_node", "node"])

    return run


def _nodes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with their node: a hash of the vector. Vectors that differ but share a hash, if any do, get another one."""
    hashed = rows.withColumn("node", F.xxhash64("v"))
    shared = hashed.groupBy("node", "v").agg(F.lit(1)).groupBy("node").count().filter("count > 1").select("node", F.lit(True).alias("shared"))
    shared = scratch.write(shared, "shared")
    if shared.isEmpty():
        return hashed
    return hashed.join(shared, "node", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64(F.lit(11), "node", "v")).otherwise(F.col("node"))).drop("shared")


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int | None = None) -> DataFrame:
    """One row (query_id, rank, vec_id, score) for each of the k nearest found of each row for which is_query holds.

    rounds: so many rounds of NN-descent, instead of until it settles.
    """
    scratch = Scratch(vectors.sparkSession, "nn")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(finite & F.exists("v", lambda x: x != 0))
    shape = rows.agg(F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    d, largest = shape["d"] or 1, shape["largest"] or 1.0
    padded = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("v"))))
    rows = scratch.write(_nodes(padded, scratch), "rows")
    first = Window.partitionBy("node").orderBy("vec_id")
    members = rows.select("node", "vec_id", "v").dropDuplicates(["node", "vec_id"]).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    members = scratch.write(members.select("node", "vec_id", "place", F.when(F.col("place") == 1, F.col("v")).alias("v")), "members")
    nodes = members.filter("place = 1").select("node", "v")
    count = nodes.count()
    bundles, width = bundles_for(count, d), beam_for(count, k)
    graph = build(nodes, d, count, largest, scratch, rounds)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x / F.lit(largest) * (x / F.lit(largest)))
    longest, spread = nodes.orderBy(F.desc(square), "node").limit(ENTRIES), nodes.orderBy(F.xxhash64("node")).limit(ENTRIES)
    chosen = {r["node"]: r["v"] for r in longest.union(spread).collect()}
    ids = np.array(sorted(chosen), np.int64)
    dirs, norms = _directions(np.array([chosen[i] for i in ids.tolist()], np.float64).reshape(-1, d) / largest) if len(ids) else (np.zeros((0, d)), np.zeros(0))
    entries = ids, dirs.astype(np.float32), norms.astype(np.float32)
    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query_node"))
    asked = queries.select(F.col("query_node").alias("node")).distinct()
    state = write(scratch, superstep(graph.union(asked.mapInArrow(_asked(bundles), ROW)), _start(bundles, d, width, entries)), "beams0")
    lists, directions = _only(graph, "a", "d"), _only(graph, "a", "b", "c")
    i = 0
    while state(BEAMS).agg(F.sum("count")).first()[0]:
        listed = superstep(state(ASK).union(lists), _list)
        scored = superstep(superstep(listed.union(state(OPEN)), _spread(bundles, d)).union(directions), _rate(d))
        i += 1
        state = write(scratch, superstep(scored.union(state(BEAMS)), _advance(bundles, d, width)), f"beams{i}")
        scratch.drop(f"beams{i - 1}")
    scratch.drop("graph", "shared")
    pairs = state(BEAMS).mapInArrow(_found(3 * k, width), "query_node long, node long")
    vector_of = nodes.withColumnRenamed("v", "w")
    both = pairs.join(vector_of, "node").join(nodes.select(F.col("node").alias("query_node"), "v"), "query_node")
    score = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = both.select("query_node", "node", score.alias("score")).join(members.select("node", "vec_id"), "node")
    order = Window.partitionBy("query_node").orderBy(F.desc("score"), "vec_id")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2 * k)
    lists = best.groupBy("query_node").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("x"), "vec_id", "score"))).alias("near"))
    # One row for each query until its own id is out: a vector that very many queries share has its list found once.
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = queries.join(lists, "query_node").select("query_id", F.posexplode(near).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
