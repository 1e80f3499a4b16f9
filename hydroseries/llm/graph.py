"""Robust-pruned directed graph over the unit vectors of one shard, in numpy.

Points join in batches: a greedy beam search over the graph so far proposes
neighbours, pruning keeps an edge to ``c`` unless a kept neighbour ``s`` is nearer
to ``c`` by the factor ``alpha``, and reverse edges are pruned alike.  Searches
of a batch advance together, a few expansions a step.
"""

from __future__ import annotations

import numpy as np

EXPAND = 4


def search(x, nbr, start, q, beam):
    """Beam search from ``start`` for each row of q: (ids, squared distances),
    nearest first; -1 pads."""
    b, n = len(q), len(x)
    ids = np.full((b, beam), -1, dtype=np.int64)
    dist = np.full((b, beam), np.inf, dtype=np.float32)
    done = np.ones((b, beam), dtype=bool)
    seen = np.zeros((b, n + 1), dtype=bool)  # the last column stands for no neighbour
    first = np.zeros((b, n + 1), dtype=np.int32)
    ids[:, 0], done[:, 0], seen[:, start], seen[:, n] = start, False, True, True
    dist[:, 0] = 2 - 2 * (q @ x[start])
    while True:
        open_dist = np.where(done, np.inf, dist)
        act = np.nonzero(np.isfinite(open_dist).any(axis=1))[0]
        if not len(act):
            break
        pick = np.argpartition(open_dist[act], EXPAND - 1, axis=1)[:, :EXPAND]
        ok = np.isfinite(np.take_along_axis(open_dist[act], pick, axis=1))
        done[act[:, None], pick] = True
        new = np.where(ok[:, :, None], nbr[ids[act[:, None], pick]], -1).reshape(len(act), -1)
        new = np.where(new < 0, n, new)
        r = act[:, None]
        first[r, new] = np.arange(new.shape[1])
        fresh = ~seen[r, new] & (first[r, new] == np.arange(new.shape[1]))
        seen[r, new] = True
        seen[:, n] = True
        # distances of fresh ones only
        i, j = np.nonzero(fresh)
        d = np.full(new.shape, np.inf, dtype=np.float32)
        d[i, j] = 2 - 2 * np.einsum("ij,ij->i", q[act[i]], x[new[i, j]])
        all_d = np.concatenate([dist[act], d], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        ids[act] = np.take_along_axis(np.concatenate([ids[act], np.where(fresh, new, -1)], axis=1), best, axis=1)
        done[act] = np.take_along_axis(np.concatenate([done[act], ~fresh], axis=1), best, axis=1)
        dist[act] = np.take_along_axis(all_d, best, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def leaders(x, least=0.95, block=256):
    """Leader of each point: itself, or an earlier leader of cosine ``least`` or
    more.  A dense clump of near copies would fill a beam; it enters the graph as
    its leader, and a search that finds the leader looks at all points it leads."""
    lead = np.arange(len(x))
    chosen = np.zeros(0, dtype=np.int64)
    for at in range(0, len(x), block):
        own = np.arange(at, min(at + block, len(x)))
        if len(chosen):
            s = x[own] @ x[chosen].T
            near = s.argmax(axis=1)
            led = s[np.arange(len(own)), near] >= least
            lead[own[led]] = chosen[near[led]]
            own = own[~led]
        s = x[own] @ x[own].T >= least
        free = np.ones(len(own), dtype=bool)
        new = []
        for i in range(len(own)):
            if free[i]:
                new.append(own[i])
                mine = s[i] & free
                lead[own[mine]] = own[i]
                free &= ~mine
        chosen = np.concatenate([chosen, np.array(new, dtype=np.int64)])
    return lead


def prune(x, p, cand, degree, alpha):
    """Robust pruning of candidate lists (-1 pads) of the points p: (len(p), degree) ids."""
    p = np.asarray(p)
    own = cand == p[:, None]
    cv = x[np.maximum(cand, 0)]
    d = 2 - 2 * np.einsum("bmd,bd->bm", cv, x[p])
    d = np.where((cand < 0) | own, np.inf, d)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, axis=1), np.take_along_axis(d, order, axis=1)
    cv = np.take_along_axis(cv, order[:, :, None], axis=1)
    between = 2 - 2 * np.matmul(cv, cv.transpose(0, 2, 1))
    alive = np.isfinite(d)
    out = np.full((len(p), degree), -1, dtype=np.int64)
    rows = np.arange(len(p))
    for k in range(degree):
        any_left = alive.any(axis=1)
        if not any_left.any():
            break
        s = alive.argmax(axis=1)  # candidates are sorted, so the first alive is the nearest
        out[:, k] = np.where(any_left, cand[rows, s], -1)
        near = between[rows, s] * (alpha * alpha) <= d
        alive &= ~(near & any_left[:, None])
        alive[rows, s] = False
    return out


def build(x, degree=32, beam=64, alpha=1.2, batch=256, seed=0):
    """(neighbours (n, degree) with -1 pads, start point) of unit vectors x (n, d)."""
    n = len(x)
    nbr = np.full((n, degree), -1, dtype=np.int64)
    start = int(np.argmax(x @ x.mean(axis=0)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 1
    while at < n:
        own = order[at:at + size]
        ids, _ = search(x, nbr, start, x[own], beam)
        # the batch's own points see each other too, so near pairs that join together are linked
        both = np.concatenate([ids, np.broadcast_to(own, (len(own), len(own)))], axis=1) if len(own) <= 32 else ids
        nbr[own] = prune(x, own, both, degree, alpha)
        src = np.repeat(own, degree)
        dst = nbr[own].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        to, begin, count = np.unique(dst, return_index=True, return_counts=True)
        for k in range(0, len(to), batch):
            t, c = to[k:k + batch], count[k:k + batch]
            add = np.full((len(t), c.max()), -1, dtype=np.int64)
            cell = np.arange(c.max())[None, :] < c[:, None]
            add[cell] = src[begin[k]:begin[k] + c.sum()]
            old = nbr[t]
            add = np.where((add[:, :, None] == old[:, None, :]).any(axis=2), -1, add)
            free = (old < 0).sum(axis=1)
            full = (add >= 0).sum(axis=1) > free
            if full.any():
                nbr[t[full]] = prune(x, t[full], np.concatenate([old[full], add[full]], axis=1), degree, alpha)
            for i in np.nonzero(~full)[0]:
                a = add[i][add[i] >= 0]
                nbr[t[i], np.nonzero(old[i] < 0)[0][:len(a)]] = a
        at += size
        size = min(batch, size * 2)
    return nbr, start
