"""Embedding near-dedup over a robust-pruned flat graph.

Vectors are dealt to the cells of their nearest cluster centres; the number of cells grows with the
table. A vector goes to as many cells as it takes that made pairs, just as close as the limit and in
random directions, nearly always have one in common. A cell beyond ``CAP`` vectors is cut into
blocks and its blocks are searched pairwise, so a hot cell is spread over tasks.

In a block the flat graph is built on small cluster shards that overlap: each shard's vectors are
pruned robustly (Subramanya et al. 2019) and the adjacency lists that a vector has in its several
shards, and those that lead to it, are united. A search begins at the shards' medoids (and at the
vector itself where it is in the graph), runs greedily with a beam over the united lists, and goes
on from every vector in range until no neighbour of one is left (range expansion). What it finds is
verified, in double precision where single could err. Recall is audited against brute force on a
bounded sample, each vector that has links counting the same; below ``RECALL`` vectors are dealt to
twice as many cells, and if that is not enough all pairs are compared.

Equal vectors are one node, so copies are never paired. Tasks return counts of links and a spanning
forest of what they linked, never the pairs. A pair that two cells share counts in the smaller.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visret.llm.common import components, cut

COSINE = 0.95
#: Vectors of a cell aimed at and of a block at most (as dealt by hash, so a few more).
CELL, CAP = 1024, 8192
#: Bytes of the sample that centres are fitted on (an eighth of its rows become centres at most);
#: vectors that recall is audited on.
SAMPLE_BYTES, AUDIT, RECALL = 16 << 20, 1024, 0.98
#: Cells of a vector to begin with, and share of the made pairs at the limit that must meet in one.
OVERLAP, MADE, MEET = 2, 2048, 0.99
#: Bytes of vectors that are broadcast at a time to compare all pairs, and cosines taken at a time.
BLOCK_BYTES, AT_ONCE = 16 << 20, 1 << 22
#: Vectors of a shard aimed at, shards of a vector, and vectors of a shard that are pruned together.
SHARD, DEALT, PIECE = 128, 3, 512
#: Near candidates of a vector in a shard, neighbours kept of them, slack of the pruning, random
#: neighbours beside them, and neighbours of a vector when its lists are united.
NEAR, CLOSE, ALPHA, FAR, DEGREE = 24, 6, 1.2, 4, 32
#: Beam of the search, nodes that it opens at a time, and queries that are searched together.
BEAM, STEP, TOGETHER = 8, 4, 256
EDGE = 1e-4  # cosines this close to the limit are taken again in double precision


def usable(v: Column) -> Column:
    """Whether a vector can link: neither null nor zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows) -> np.ndarray:
    """Rows as unit vectors in double precision, safe for very large and small components."""
    x = np.array(rows, float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_width(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, unit rows) of the vectors of each length in a list column without nulls."""
    sizes, values = pc.list_value_length(vectors).to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        yield width, at, unit(values[begin[at][:, None] + np.arange(width)])


def whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def overlap_for(x: np.ndarray, c: np.ndarray, rng: np.random.Generator) -> int:
    """The least number of cells at which pairs made of rows of ``x`` and a vector at COSINE to each, in a
    random direction, share one of their nearest centres ``c`` in ``MEET`` of the cases."""
    x = x[rng.permutation(len(x))[:MADE]]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    y = COSINE * x + np.sqrt(1 - COSINE**2) * u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    rank = [np.argsort(np.argsort(-(z @ c.T), axis=1, kind="stable"), axis=1) for z in (x, y)]
    first = np.maximum(*rank).min(1)  # the overlap at which a pair meets is one more
    return int(max(OVERLAP, np.quantile(first, MEET, method="higher") + 1))


def centres(classes: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """Length of vectors -> unit centres, by spherical k-means on a bounded sample; and the number of
    cells a vector that all of them need."""
    n, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return {}, OVERLAP
    most = max(256, SAMPLE_BYTES // (8 * width))
    draw = F.pmod("h1", F.lit(1 << 30))
    rows = classes.where(draw < min(1.0, 1.5 * most / n) * (1 << 30)).orderBy(draw, "h1", "h2").limit(most).select("embedding").toPandas()
    rng, out, overlap = np.random.default_rng(3), {}, OVERLAP
    sizes = rows["embedding"].map(len)
    for size, some in rows["embedding"].groupby(sizes):
        x = unit(list(some))
        k = int(max(1, min(n * len(x) / len(rows) / CELL, len(x) // 8)))
        c = x[rng.permutation(len(x))[:k]]
        for _ in range(6):
            best = (x @ c.T).argmax(1)
            total = np.zeros_like(c)
            np.add.at(total, best, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
        out[int(size)] = c
        overlap = max(overlap, overlap_for(x, c, rng))
    return out, overlap


def dealt(classes: DataFrame, found: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """classes with ``cells``: the numbers of each vector's ``overlap`` nearest centres, sorted."""
    shared = classes.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def nearest(vectors: pa.Array) -> pa.Array:
        out = [None] * len(vectors)
        for width, at, x in by_width(vectors):
            c = shared.value.get(width)
            near = np.zeros((len(at), 1), np.int64) if c is None or len(c) == 1 else most_like(x, c, overlap)
            for i, cells in zip(at, np.sort(near + (width << 32), axis=1), strict=True):
                out[i] = cells
        return pa.array(out, pa.list_(pa.int64()))

    return classes.withColumn("cells", nearest.asNondeterministic()("embedding"))


def most_like(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Places in ``c`` of the ``k`` rows most like each of ``x``, in no order."""
    k = min(k, len(c))
    return np.argpartition(-(x @ c.T), k - 1, axis=1)[:, :k]


def pruned(s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """From cosines of a shard's vectors, neighbours of each, -1 where there are fewer: CLOSE of its
    near ones, nearest first, those that no neighbour already kept is much nearer to; and FAR random
    ones, so that a tight cluster is not cut off from what is around it."""
    n = len(s)
    near = min(NEAR, n - 1)
    out = np.full((n, CLOSE + FAR), -1)
    if not near:
        return out
    far = (np.arange(n)[:, None] + rng.integers(1, n, (n, FAR))) % n
    out[:, CLOSE:] = far
    s = s.copy()
    np.fill_diagonal(s, -2)
    cand = np.argpartition(-s, near - 1, axis=1)[:, :near]
    gap = 1 - np.take_along_axis(s, cand, 1)
    order = np.argsort(gap, axis=1, kind="stable")
    cand, gap = np.take_along_axis(cand, order, 1), np.take_along_axis(gap, order, 1)
    alive, every = np.ones(cand.shape, bool), np.arange(n)
    for k in range(CLOSE):
        first = alive.argmax(1)
        some = alive[every, first]
        pick = cand[every, first]
        out[some, k] = pick[some]
        alive &= (ALPHA * (1 - s[pick[:, None], cand]) > gap) & (cand != pick[:, None]) & some[:, None]
        if not alive.any():
            break
    return out


def graph(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each row of ``x``, DEGREE columns, -1 where there are fewer, united from
    overlapping cluster shards; and the medoids of the shards."""
    n = len(x)
    c = x[rng.permutation(n)[:max(1, n // SHARD)]]
    for _ in range(3):
        best = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c)
    near = most_like(x, c, DEALT)
    shard, node = near.ravel(), np.repeat(np.arange(n), near.shape[1])
    order = np.lexsort((rng.random(len(node)), shard))
    shard, node = shard[order], node[order]
    medoids, parts = [], []
    for run in np.split(node, np.flatnonzero(np.diff(shard)) + 1):
        for piece in np.array_split(run, -(-len(run) // PIECE)):
            own = x[piece]
            medoids.append(piece[(own @ own.mean(0)).argmax()])
            out = pruned(own @ own.T, rng)
            a, k = np.nonzero(out >= 0)
            parts.append((piece[a], piece[out[a, k]], k))
    a, b, rank = (np.concatenate(p) for p in zip(*parts, strict=True))
    a, b, rank = np.r_[a, b], np.r_[b, a], np.r_[2 * rank, 2 * rank + 1]  # with the way back
    order = np.lexsort((rank, a * n + b))
    a, b, rank = a[order], b[order], rank[order]
    fresh = np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)] if len(a) else np.zeros(0, bool)
    a, b, rank = a[fresh], b[fresh], rank[fresh]
    order = np.lexsort((rank, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    lists = np.full((n, DEGREE), -1)
    lists[a[place < DEGREE], place[place < DEGREE]] = b[place < DEGREE]
    return lists, np.unique(medoids)


def cosines(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs of rows ``a`` of q and ``b`` of x."""
    out = np.empty(len(a), q.dtype)
    for i in range(0, len(a), 1 << 15):
        j = slice(i, i + (1 << 15))
        np.einsum("ij,ij->i", q[a[j]], x[b[j]], out=out[j])
    return out


def search(q: np.ndarray, x: np.ndarray, lists: np.ndarray, medoids: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``q``, row of ``x``) within COSINE less EDGE, by the graph of ``x``; ``own``
    are the rows of ``x`` that the queries are themselves."""
    d = np.full((len(q), len(x)), -2, np.float32)
    every = np.arange(len(q))[:, None]
    d[:, medoids] = q @ x[medoids].T
    ids = np.broadcast_to(medoids, (len(q), len(medoids)))
    if own is not None:
        d[every[:, 0], own] = np.einsum("ij,ij->i", q, x[own])
        ids = np.c_[own, np.where(medoids == own[:, None], -1, medoids)]
    score = np.where(ids >= 0, d[every, ids], np.float32(-3))
    opened = ids < 0
    row = every[:, 0]
    while len(row):
        if ids.shape[1] > BEAM:
            top = np.argpartition(-score, BEAM - 1, axis=1)[:, :BEAM]
            ids, score, opened = (np.take_along_axis(v, top, 1) for v in (ids, score, opened))
        go = ~opened.all(1)
        ids, score, opened, row = ids[go], score[go], opened[go], row[go]
        if not len(row):
            break
        step = min(STEP, ids.shape[1])
        top = np.argpartition(np.where(opened, np.float32(4), -score), step - 1, axis=1)[:, :step]
        to = np.where(np.take_along_axis(opened, top, 1), -1, np.take_along_axis(ids, top, 1))
        np.put_along_axis(opened, top, True, 1)
        next_ = np.where(to[:, :, None] >= 0, lists[to], -1).reshape(len(row), -1)
        next_.sort(axis=1)
        fresh = (next_ >= 0) & np.c_[np.ones(len(row), bool), np.diff(next_, axis=1) > 0] & (d[row[:, None], next_] == -2)
        a, k = np.nonzero(fresh)
        b = next_[a, k]
        got = cosines(q, x, row[a], b)
        d[row[a], b] = got
        width = int(fresh.sum(1).max(initial=0))
        slot = np.arange(len(a)) - np.searchsorted(a, a)
        more, value = np.full((len(row), width), -1), np.full((len(row), width), -3, np.float32)
        more[a, slot], value[a, slot] = b, got
        ids, score, opened = np.c_[ids, more], np.c_[score, value], np.c_[opened, more < 0]
    limit = np.float32(COSINE - EDGE)
    a, b = np.nonzero(d >= limit)
    while len(a):  # on from what is in range
        parts = []
        for i in range(0, len(a), 1 << 14):
            some, next_ = np.repeat(a[i:i + (1 << 14)], lists.shape[1]), lists[b[i:i + (1 << 14)]].ravel()
            ok = (next_ >= 0) & (d[some, next_] == -2)
            key = np.unique(some[ok] * len(x) + next_[ok])
            u, v = key // len(x), key % len(x)
            got = cosines(q, x, u, v)
            d[u, v] = got
            parts.append((u[got >= limit], v[got >= limit]))
        a, b = (np.concatenate(p) for p in zip(*parts, strict=True))
    return np.nonzero(d >= limit)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the smallest place of each place's group, after joining places ``a`` and ``b``."""
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        for v in (label[a], label[b]):  # their roots only, so that no group is parted
            np.minimum.at(label, v, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def found_rows(node: np.ndarray, n: np.ndarray, label: np.ndarray) -> pa.Table:
    """Rows (a, b, n) of counts and of the edges of a spanning forest."""
    some, moved = n > 0, label != np.arange(len(label))
    return pa.table({"a": np.r_[node[some], node[moved]],
                     "b": pa.array([None] * int(some.sum()) + node[label[moved]].tolist(), pa.int64()),
                     "n": pa.array(n[some].tolist() + [None] * int(moved.sum()), pa.int64())})


def linked(members: DataFrame) -> DataFrame:
    """(a, b, n): n links counted for node a (b null), or that a and b are connected (n null), of
    ``members(cell, qb, gb, block, node, n, cells, embedding)``."""
    def find(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell, qb, gb = (k.as_py() for k in key)
        node, size, block = (table[c].to_numpy() for c in ("node", "n", "block"))
        [(_, _, x)] = by_width(whole(table["embedding"]))
        cells = np.array(table["cells"].to_pylist())
        x4 = x.astype(np.float32)
        iq, ig = np.flatnonzero(block == qb), np.flatnonzero(block == gb)
        lists, medoids = graph(x4[ig], np.random.default_rng(5))
        count, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for i in range(0, len(iq), TOGETHER):
            some = iq[i:i + TOGETHER]
            a, b = search(x4[some], x4[ig], lists, medoids, np.arange(i, i + len(some)) if qb == gb else None)
            a, b = some[a], ig[b]
            for j in range(0, len(a), 1 << 18):
                u, v = a[j:j + (1 << 18)], b[j:j + (1 << 18)]
                near = (u != v) & (cosines(x, x, u, v) >= COSINE)
                u, v = u[near], v[near]
                label = joined(label, u, v)
                # what two cells share counts in the smaller
                before = ((cells[u][:, :, None] == cells[v][:, None, :]) & (cells[u] < cell)[:, :, None]).any((1, 2))
                np.add.at(count, u[~before], size[v[~before]])
        return found_rows(node, count, label)

    return members.groupBy("cell", "qb", "gb").applyInArrow(find, "a long, b long, n long")


def in_cells(classes: DataFrame, found: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """``linked`` over all cells, each as one block or, beyond CAP vectors, as pairs of blocks."""
    spread = cut(dealt(classes.select("node", "n", "embedding"), found, overlap))
    sizes = spread.select(F.explode("cells").alias("cell")).groupBy("cell").count()
    blocks = F.broadcast(sizes.select("cell", F.ceil(F.col("count") / CAP).cast("int").alias("blocks")))
    members = spread.withColumn("cell", F.explode("cells")).join(blocks, "cell").withColumn("block", F.pmod(F.hash("node", F.lit(17)), F.col("blocks")))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.array_distinct(F.concat(
        F.transform(every, lambda i: F.struct(F.col("block").alias("qb"), i.alias("gb"))),
        F.transform(every, lambda i: F.struct(i.alias("qb"), F.col("block").alias("gb")))))
    return linked(members.withColumn("pair", F.explode(pairs)).select("cell", "pair.qb", "pair.gb", "block", "node", "n", "cells", "embedding"))


def every_link(classes: DataFrame) -> DataFrame:
    """As ``linked``, by comparing all pairs: vectors are broadcast in blocks, one pass each."""
    spark, parts, block, size = classes.sparkSession, [], [], 0

    def against(block) -> DataFrame:
        shared = spark.sparkContext.broadcast({
            width: (np.array([r[0] for r in some]), unit([r[2] for r in some]), np.array([r[1] for r in some]))
            for width in {len(r[2]) for r in block} for some in [[r for r in block if len(r[2]) == width]]})

        def find(batches):
            for batch in batches:
                node = batch.column(0).to_numpy()
                for width, at, x in by_width(batch.column(1)):
                    if width not in shared.value:
                        continue
                    other, g, n = shared.value[width]
                    step = max(1, AT_ONCE // len(g))
                    for i in range(0, len(at), step):
                        mine = node[at[i:i + step]]
                        hit = (x[i:i + step] @ g.T >= COSINE) & (mine[:, None] != other[None, :])
                        names, place = np.unique(np.r_[mine, other], return_inverse=True)
                        a, b = np.nonzero(hit)
                        count = np.zeros(len(names), np.int64)
                        np.add.at(count, place[:len(mine)], hit @ n)
                        yield from found_rows(names, count, joined(np.arange(len(names)), place[a], place[len(mine) + b])).to_batches()

        return classes.select("node", "embedding").mapInArrow(find, "a long, b long, n long")

    for r in classes.select("node", "n", "embedding").toLocalIterator():
        if block and size + 8 * len(r[2]) > BLOCK_BYTES:
            parts.append(cut(against(block)))
            block, size = [], 0
        block.append(r)
        size += 8 * len(r[2])
    parts.append(cut(against(block)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audited(classes: DataFrame, counted: DataFrame) -> float:
    """Share of its links that were counted, as a mean over those of a bounded sample of nodes that
    have links to other nodes; 1 if none has, as then none can be lost.

    The sample is broadcast and compared with every vector by brute force; each partition returns
    one row per sampled vector."""
    draw, share = F.pmod("h2", F.lit(1 << 30)), min(1.0, 2 * AUDIT / max(1, classes.count()))
    some = classes.where(draw < share * (1 << 30)).orderBy(draw, "h1", "h2").limit(AUDIT).select("node", "embedding").collect()
    if not some:
        return 1.0
    shared = classes.sparkSession.sparkContext.broadcast([(r[0], list(r[1])) for r in some])

    def exact(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            node, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for width, at, y in by_width(batch.column(1)):
                mine = [i for i, (_, v) in enumerate(shared.value) if len(v) == width]
                if mine:
                    x, own = unit([shared.value[i][1] for i in mine]), np.array([shared.value[i][0] for i in mine])
                    for i in range(0, len(at), AUDIT):
                        some = at[i:i + AUDIT]
                        near = (x @ y[i:i + AUDIT].T >= COSINE) & (own[:, None] != node[some][None, :])
                        total[mine] += near @ n[some]
        yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in shared.value], pa.int64()), pa.array(total)], ["node", "exact"])

    truth = classes.select("node", "embedding", "n").mapInArrow(exact, "node long, exact long").groupBy("node").agg(F.sum("exact").alias("exact"))
    share = F.least("exact", F.coalesce("links", F.lit(0))) / F.col("exact")
    got = truth.where("exact > 0").join(counted, "node", "left").agg(F.sum(share), F.count("*")).first()
    return got[0] / got[1] if got[1] else 1.0


def near_dups(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of ``vectors``.

    Vectors that are null, empty, zero or have a null or non-finite component link with nothing,
    nor do vectors of different lengths. Repeated rows link with each other. Null vec_ids never
    name a component and are not kept. Other columns, whatever their names, are not read.
    """
    rows = cut(vectors.select("vec_id", "embedding").where(usable(F.col("embedding")))
               .select("vec_id", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.reverse("embedding"), F.lit(1)).alias("h2"), "embedding"))
    classes = cut(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
                  .withColumn("node", F.monotonically_increasing_id()))
    found, begin = centres(classes)
    for overlap in (begin, 2 * begin, None):
        if overlap is None:
            found_links = cut(every_link(classes))
            counted = found_links.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
            break
        found_links = cut(in_cells(classes, found, overlap))
        counted = found_links.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
        if audited(classes, counted) >= RECALL:
            break
    comps = components(found_links.where("b is not null").select("a", "b")).withColumnRenamed("id", "node")
    within = comps.join(classes.select("node", "least"), "node")
    best = within.groupBy("component").agg(F.min("least").alias("best"))
    moved = within.join(best, "component").select("node", "best")
    named = (classes.select("node", "h1", "h2", "n", "least").join(counted, "node", "left").join(moved, "node", "left")
             .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("best", "least").alias("component_id")))
    alone = vectors.where(~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
