"""Walks over edges: frontier loops that checkpoint every level, cycles, paths, betweenness."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import both_directions, degree, degree_at
from loomgraph.runtime import checkpoint, numbered, shuffles_removed

#: Relations along which a change spreads to its users, and those that own members.
IMPACT = ("calls", "indirect_call", "imports", "imports_from", "references", "uses", "inherits", "implements", "extends", "mixes_in", "embeds", "re_exports")
MEMBERS = ("method", "contains")
#: Steps of one start that stay together; a start with more of them is spread.
HEAVY = 100_000


def dealt(steps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(steps, heavy): steps kept by their start for all levels of a walk, so that only frontiers are shuffled then.

    The steps of a start with more than ``HEAVY`` of them are spread over parts of that size; ``heavy`` (start, parts)
    says which, or is None where no start has so many. A lost executor's part is computed again from its lineage; the walk's own results are checkpointed.
    """
    heavy = steps.groupBy(F.col("a").alias("start")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HEAVY)
    heavy = checkpoint(heavy.select("start", F.ceil(F.col("k") / HEAVY).cast("int").alias("parts")))
    if not heavy.limit(1).count():
        return steps.repartition("a").persist(), None
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), "parts")).cast("int")
    placed = steps.join(heavy, steps["a"] == heavy["start"], "left").withColumn("part", part).drop("start", "parts")
    return placed.repartition("a", "part").persist(), heavy


def stepped(front: DataFrame, steps: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """``front`` (id, ...) joined with the steps that leave it; only a heavy node's row is copied, once for each part."""
    if heavy is None:
        return front.join(steps, front["id"] == steps["a"])
    at = front.join(heavy, front["id"] == heavy["start"], "left")
    at = at.withColumn("at", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("start", "parts")
    return at.join(steps, (at["id"] == steps["a"]) & (at["at"] == steps["part"])).drop("at", "part")


def walk(steps: DataFrame, seeds: DataFrame, max_depth: int, blocked: DataFrame | None = None, track: bool = False) -> DataFrame:
    """``id, depth`` (and ``parent, relation`` with ``track``) first reached from ``seeds`` (id) along ``steps``.

    ``steps``: a, b, relation. Nodes of ``blocked`` (id) are reached but not walked on from, unless they are
    seeds: their steps go before any are dealt. Among several ways to a node at its first depth the smallest
    (relation, parent) counts. Levels are added to what has been seen; none is written twice.
    """
    cols = ["id", "depth"] + (["relation", "parent"] if track else [])
    base = steps = steps.persist()  # counted, then dealt
    if blocked is not None:
        stops = blocked.select(F.col("id").alias("a")).join(seeds.select(F.col("id").alias("a")), "a", "left_anti")
        steps = steps.join(stops, "a", "left_anti")
    steps, heavy = dealt(steps)
    null = F.lit(None).cast("string")
    seen = checkpoint(seeds.select("id", F.lit(0).alias("depth"), null.alias("relation"), null.alias("parent")).distinct())
    front = seen.select("id")
    for level in range(1, max_depth + 1):
        new = stepped(front, steps, heavy).select(F.col("b").alias("id"), "relation", F.col("a").alias("parent"))
        new = new.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("relation", "parent")).alias("m"))
        new = checkpoint(new.select("id", F.lit(level).alias("depth"), "m.relation", "m.parent"))
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new)
        front = new.select("id")
    steps.unpersist()
    base.unpersist()
    return seen.select(*cols)


def bfs(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, directed: bool = False) -> DataFrame:
    """``id, depth`` around the seeds; hubs (degree of the 99th percentile, 50 at least) stop the walk."""
    ways = edges.select("src", "dst", "relation").persist()  # read for the degrees, then for the steps
    d = checkpoint(degree(nodes, ways))
    limit = F.greatest(F.lit(50), "threshold")
    # the threshold is one row
    hubs = checkpoint(d.join(F.broadcast(degree_at(d, 0.99)), F.col("degree") >= limit).select("id"))
    steps = ways.select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation") if directed else both_directions(ways)
    found = walk(steps, seeds, depth, hubs)
    ways.unpersist()
    return found


def reverse_impact(edges: DataFrame, seed: str, depth: int = 2, relations: tuple[str, ...] = IMPACT) -> DataFrame:
    """``id, depth, relation`` of what depends on ``seed`` or its members; neither is reported."""
    spark = edges.sparkSession
    own = edges.where((F.col("src") == seed) & F.col("relation").isin(*MEMBERS)).select(F.col("dst").alias("id"))
    seeds = spark.createDataFrame([(seed,)], "id string").unionByName(own)
    back = edges.where(F.col("relation").isin(*relations)).select(F.col("dst").alias("a"), F.col("src").alias("b"), "relation")
    return walk(back, seeds, depth, track=True).where("depth > 0").select("id", "depth", "relation")


def impact_prediction(nodes: DataFrame, edges: DataFrame, targets: list[str], depth: int = 2) -> DataFrame:
    """``id, target, depth, source_file``: each affected node under the first target that reaches it."""
    out = None
    for k, t in enumerate(targets):
        one = reverse_impact(edges, t, depth).select("id", F.lit(k).alias("k"), F.lit(t).alias("target"), "depth")
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("id").agg(F.min(F.struct("k", "target", "depth")).alias("m")).select("id", "m.target", "m.depth")
    return best.where(~F.col("id").isin(*targets)).join(nodes.select("id", "source_file"), "id")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 8) -> DataFrame:
    """``src, dst, hops`` for each pair within ``max_hops``, whatever the directions of edges.

    All pairs are searched together, from both ends in turn: a frontier row is (origin, node), and a pair is as long
    as the sum of both radii when its frontiers first share a node. Pairs that are found leave, and levels are added
    to what has been seen instead of rewriting it.
    """
    base = both_directions(edges.select("src", "dst")).distinct().persist()
    steps, heavy = dealt(base)
    open_ = checkpoint(pairs.select("src", "dst").distinct())
    found = open_.where("src = dst").select("src", "dst", F.lit(0).alias("hops"))
    open_ = open_.where("src <> dst")
    front = {end: checkpoint(open_.select(F.col(end).alias("origin"), F.col(end).alias("id")).distinct()) for end in ("src", "dst")}
    seen = dict(front)
    for level in range(1, max_hops + 1):
        end = "src" if level % 2 else "dst"
        live = front[end].join(open_.select(F.col(end).alias("origin")).distinct(), "origin", "left_semi")
        new = stepped(live, steps, heavy).select("origin", F.col("b").alias("id")).distinct()
        new = checkpoint(new.join(seen[end], ["origin", "id"], "left_anti"))
        front[end], seen[end] = new, seen[end].unionByName(new)
        ahead = front["src"].select(F.col("origin").alias("src"), "id")
        back = front["dst"].select(F.col("origin").alias("dst"), "id")
        hit = checkpoint(open_.join(ahead, "src").join(back, ["dst", "id"], "left_semi").select("src", "dst").distinct())
        found = found.unionByName(hit.withColumn("hops", F.lit(level)))
        open_ = checkpoint(open_.join(hit, ["src", "dst"], "left_anti"))
        if not open_.limit(1).count() or not new.limit(1).count():
            break
    steps.unpersist()
    base.unpersist()
    return found


def shortest_path(edges: DataFrame, src: str, dst: str, max_hops: int = 8) -> list[str]:
    """Node ids of one shortest undirected path, the smallest by parents; empty where there is none."""
    steps = both_directions(edges.select("src", "dst", "relation"))
    seeds = edges.sparkSession.createDataFrame([(src,)], "id string")
    reached = checkpoint(walk(steps, seeds, max_hops, track=True))
    path = [dst]
    for _ in range(max_hops + 1):
        row = reached.where(F.col("id") == path[-1]).first()
        if row is None:
            return []
        if row["parent"] is None:
            return path[::-1]
        path.append(row["parent"])
    return []


def bounded_cycles(edges: DataFrame, max_length: int = 5, top_n: int | None = 20) -> DataFrame:
    """``length, cycle`` of simple directed cycles, each once from its smallest node, shortest first.

    Paths start at their smallest node and only visit larger ones, which prunes all rotations.
    """
    e = edges.select(F.col("src").alias("s"), F.col("dst").alias("t")).distinct()
    loops = e.where("s = t").select(F.lit(1).alias("length"), F.array("s").alias("path"))
    paths = e.where("s < t").select(F.array("s", "t").alias("path"))
    out = loops
    for n in range(2, max_length + 1):
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        closed = paths.join(e, (last == F.col("s")) & (first == F.col("t"))).select(F.lit(n).alias("length"), "path")
        out = out.unionByName(closed)
        if n < max_length:
            longer = paths.join(e, (last == F.col("s")) & (F.col("t") > first)).where(~F.array_contains("path", F.col("t")))
            paths = longer.select(F.concat("path", F.array("t")).alias("path"))
    out = out.select("length", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"))
    return out.orderBy("length", "cycle").limit(top_n) if top_n else out


def file_dependencies(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...] = ("imports", "imports_from", "re_exports")) -> DataFrame:
    """``src, dst``: distinct pairs of files between which an import runs."""
    a = nodes.select(F.col("id").alias("src"), F.col("source_file").alias("fa"))
    b = nodes.select(F.col("id").alias("dst"), F.col("source_file").alias("fb"))
    e = edges.where(F.col("relation").isin(*relations)).join(a, "src").join(b, "dst").where("fa <> fb")
    return e.select(F.col("fa").alias("src"), F.col("fb").alias("dst")).distinct()


def import_closure(deps: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """``id, depth`` of the files that ``start`` (id) needs, itself included."""
    return walk(deps.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("imports").alias("relation")), start, depth)


def tests_for(deps: DataFrame, closure: DataFrame, is_test) -> DataFrame:
    """``id``: test files that import any file of the closure."""
    t = deps.where(is_test(F.col("src")))
    return t.join(closure.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def depth_first(nodes: DataFrame, edges: DataFrame, seed: str, depth: int = 3, limit: int = 20_000) -> list[str]:
    """Preorder from ``seed`` with a depth bound, children by id; hubs aren't walked on from.

    The order is sequential by nature: the neighbourhood within the depth comes to the driver, which refuses
    more than ``limit`` nodes.
    """
    reached = bfs(nodes, edges, edges.sparkSession.createDataFrame([(seed,)], "id string"), depth)
    if reached.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} nodes within {depth} steps")
    d = degree(nodes, edges)
    top = max(50, degree_at(d, 0.99).first()[0] or 0)
    hubs = {r["id"] for r in reached.join(d.where(F.col("degree") >= top), "id").collect()} - {seed}
    inner = both_directions(edges.select("src", "dst")).distinct()
    inner = inner.join(reached.select(F.col("id").alias("a")), "a", "left_semi").join(reached.select(F.col("id").alias("b")), "b", "left_semi")
    near: dict[str, list[str]] = {}
    for r in inner.collect():
        near.setdefault(r["a"], []).append(r["b"])
    order, seen, stack = [], set(), [(seed, 0)]
    while stack:
        node, level = stack.pop()
        if node in seen or level > depth:
            continue
        seen.add(node)
        order.append(node)
        if node not in hubs:
            stack += [(b, level + 1) for b in sorted(near.get(node, []), reverse=True) if b not in seen]
    return order


def _hashes(ids: DataFrame, entries: int = 250_000) -> DataFrame:
    """``first, n, twice, hashes``: the 64-bit hashes of ``ids`` (distinct) in order, packed; ``twice`` counts those that two ids share."""

    def pack(batches):
        held, size, last = [], 0, None

        def row():
            nonlocal last
            h = np.concatenate(held)
            twice = int((h[1:] == h[:-1]).sum()) + int(last == h[0])
            last = h[-1]
            return pa.RecordBatch.from_pydict({"first": pa.array([int(h[0])], pa.int64()), "n": pa.array([len(h)], pa.int64()), "twice": pa.array([twice], pa.int64()), "hashes": pa.array([h.astype("<i8").tobytes()], pa.binary())})

        for x in batches:
            held.append(x.column(0).to_numpy(zero_copy_only=False))
            size += x.num_rows
            if size >= entries:
                yield row()
                held, size = [], 0
        if size:
            yield row()

    h = ids.where("id is not null").select(F.xxhash64("id").alias("h"))
    return checkpoint(h.repartitionByRange("h").sortWithinPartitions("h").mapInArrow(pack, "first long, n long, twice long, hashes binary"))


def _adjacency(hashes: DataFrame, edges: DataFrame, tasks: int, entries: int = 250_000) -> DataFrame:
    """``first, strange, n, ends, counts, near``: for each node the neighbours of a greater number, once each, as packed 32-bit numbers.

    A node's number is the place of its hash among ``hashes``, which every task gets through the shuffle; an edge travels as two
    hashes, to the task of the smaller one. Rows without ``ends`` hold, from node ``first`` on, how many neighbours the task has for each. ``strange`` counts ends that aren't among them; their edges are left out.
    """

    def pack(batches):
        names, pairs, at = [], [], 0
        for x in batches:
            h = x.column("hashes")
            if h.null_count < len(h):
                names += [(f, np.frombuffer(v, "<i8")) for f, v in zip(x.column("first").to_pylist(), h.to_pylist()) if v is not None]
            u, v = (np.asarray(x.column(c).drop_null()) for c in ("u", "v"))
            while len(u):  # copied, since a view would hold all columns of its batch
                if not pairs or at == pairs[-1].shape[1]:
                    pairs.append(np.empty((2, 1 << 20), "i8"))
                    at = 0
                k = min(len(u), pairs[-1].shape[1] - at)
                pairs[-1][0, at : at + k], pairs[-1][1, at : at + k] = u[:k], v[:k]
                u, v, at = u[k:], v[k:], at + k
        if not pairs:
            return
        pairs[-1] = pairs[-1][:, :at]
        known = np.concatenate([v for _, v in sorted(names, key=lambda r: r[0])] or [np.array([], "i8")])
        del names
        keys, strange, size = [], 0, len(known)
        while pairs:
            u, v = pairs.pop()
            i, j = np.searchsorted(known, u), np.searchsorted(known, v)
            ok = (i < len(known)) & (j < len(known))
            ok[ok] = (known[i[ok]] == u[ok]) & (known[j[ok]] == v[ok])
            strange += int((~ok).sum())
            keys.append((i << 32 | j)[ok])
        del known
        keys = np.concatenate(keys)
        keys.sort()
        kinds = (*[pa.int64()] * 3, *[pa.binary()] * 3)

        def row(*cells):
            return pa.RecordBatch.from_arrays([pa.array([c.astype("<i4").tobytes() if isinstance(c, np.ndarray) else c], t) for c, t in zip(cells, kinds)], ["first", "strange", "n", "ends", "counts", "near"])

        degrees = np.zeros(size, "i4")
        for lo in range(0, len(keys), entries):
            part = keys[lo : lo + entries]
            part = part[np.diff(part, prepend=keys[lo - 1] if lo else -1) > 0]
            if len(part):
                ends, counts = np.unique(part >> 32, return_counts=True)
                back, many = np.unique(part & 0xFFFFFFFF, return_counts=True)
                degrees[ends] += counts.astype("i4")
                degrees[back] += many.astype("i4")
                yield row(int(ends[0]), 0, len(part), ends, counts, part & 0xFFFFFFFF)
        del keys
        for lo in range(0, max(1, size), 4 * entries):
            yield row(lo, strange if lo == 0 else 0, 0, None, degrees[lo : lo + 4 * entries], None)

    h = [F.xxhash64(c) for c in ("src", "dst")]
    pairs = edges.where("src <> dst").select(F.least(*h).alias("u"), F.greatest(*h).alias("v")).withColumn("task", F.pmod("u", F.lit(tasks)).cast("int"))
    copies = hashes.select("first", "hashes", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"))
    sent = pairs.unionByName(copies, allowMissingColumns=True).repartitionById(tasks, F.col("task"))
    return checkpoint(sent.select("first", "hashes", "u", "v").mapInArrow(pack, "first long, strange long, n long, ends binary, counts binary, near binary"))


def cuts(sizes, most: int):
    """(from, to) of consecutive items with ``most`` in sum, or one larger item."""
    upto, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _dependencies(ptr, near, s: int, total, most: int = 1 << 20) -> None:
    """Adds to ``total`` what source ``s`` gives every other node: Brandes' sums, level by level over packed neighbours."""
    n = len(ptr) - 1
    dist, sigma = np.full(n, -1, "i2"), np.zeros(n)
    dist[s], sigma[s] = 0, 1.0
    levels = [np.array([s])]

    def steps(front):
        size = ptr[front + 1] - ptr[front]
        front, size = front[size > 0], size[size > 0]
        for lo, hi in cuts(size, most):
            k = size[lo:hi]
            begin = np.cumsum(k) - k
            yield front[lo:hi], k, begin, near[np.repeat(ptr[front[lo:hi]] - begin, k) + np.arange(begin[-1] + k[-1])]

    while len(levels[-1]):
        level, fresh = len(levels), []
        if level == 1 << 15:
            dist = dist.astype("i4")
        for v, k, _, w in steps(levels[-1]):
            at = dist[w]
            new = at < 0
            ahead = new | (at == level)
            dist[w[new]] = level
            np.add.at(sigma, w[ahead], np.repeat(sigma[v], k)[ahead])
            fresh.append(w[new])
        reached = sum(map(len, fresh))
        levels.append(np.flatnonzero(dist == level) if reached > n >> 6 else np.unique(np.concatenate(fresh)).astype("i8") if reached else np.array([], "i8"))
    share = np.zeros(n)  # (1 + delta) / sigma of the nodes a level farther
    for level in range(len(levels) - 2, -1, -1):
        front = levels[level]
        delta = np.zeros(len(front))
        done = 0
        ends = ptr[front + 1] > ptr[front]
        found = np.zeros(int(ends.sum()))
        for v, k, begin, w in steps(front):
            found[done : done + len(v)] = sigma[v] * np.add.reduceat(np.where(dist[w] == level + 1, share[w], 0.0), begin)
            done += len(v)
        delta[ends] = found
        share[front] = (1 + delta) / sigma[front]
        if level:
            total[front] += delta


def _packed_sums(packed: DataFrame, sources: list[int], n: int, tasks: int) -> DataFrame:
    """``k, score``: sums of the sources' dependencies; every task gets the packed neighbours and its share of the sources."""

    def work(batches):
        ptr, at, near, task = np.zeros(n + 1, "i8"), None, None, None
        for x in batches:
            for r in x.to_pylist():
                task, counts = r["task"], np.frombuffer(r["counts"], "<i4")
                if r["ends"] is None:
                    ptr[r["first"] + 1 : r["first"] + 1 + len(counts)] += counts
                    continue
                if at is None:
                    np.cumsum(ptr, out=ptr)
                    at = ptr[:-1].copy()
                    with tempfile.TemporaryFile() as f:  # a local file that is gone at the end: the system may drop its pages
                        near = np.memmap(f, "i4", "w+", shape=int(ptr[-1])) if ptr[-1] >= 1 << 25 else np.empty(ptr[-1], "i4")
                ends, part = (np.frombuffer(r[c], "<i4") for c in ("ends", "near"))
                back, many = np.unique(part, return_counts=True)
                own = np.repeat(ends, counts)
                order = np.argsort(part, kind="stable")
                for of, k, to in ((ends, counts, part), (back, many, own[order])):
                    near[np.repeat(at[of] - (np.cumsum(k) - k), k) + np.arange(len(to))] = to
                    at[of] += k
        if near is None:
            return
        near = np.asarray(near)
        del at
        total = np.zeros(n)
        for s in sources[task::tasks]:
            _dependencies(ptr, near, s, total)
        some = np.flatnonzero(total)
        for lo in range(0, len(some), 100_000):
            k = some[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k])], ["k", "score"])

    dealt_out = packed.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    found = dealt_out.repartitionById(tasks, F.col("task")).sortWithinPartitions(F.col("ends").isNotNull(), "first").mapInArrow(work, "k long, score double")
    return found.groupBy("k").agg(F.sum("score").alias("score"))


def _row_sums(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """What ``_packed_sums`` gives, by joins of (source, node) rows for each level; no worker holds the graph."""
    steps, heavy = dealt(pairs)
    levels = [checkpoint(sources.select(F.col("k").alias("s"), F.col("k").alias("id"), F.lit(1.0).alias("sigma")))]
    seen = levels[0].select("s", "id")
    while levels[-1].limit(1).count():
        new = stepped(levels[-1], steps, heavy).join(seen.select("s", F.col("id").alias("b")), ["s", "b"], "left_anti")
        levels.append(checkpoint(new.groupBy("s", F.col("b").alias("id")).agg(F.sum("sigma").alias("sigma"))))
        seen = seen.unionByName(levels[-1].select("s", "id"))
    out, share = [], None
    for level in range(len(levels) - 2, 0, -1):
        now = levels[level].withColumn("delta", F.lit(0.0))
        if share is not None:
            back = stepped(share, steps, heavy).groupBy("s", F.col("b").alias("id")).agg(F.sum("share").alias("more"))
            now = levels[level].join(back, ["s", "id"], "left").withColumn("delta", F.col("sigma") * F.coalesce("more", F.lit(0.0)))
        now = checkpoint(now)
        out.append(now.groupBy(F.col("id").alias("k")).agg(F.sum("delta").alias("score")))
        share = now.select("s", "id", ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
    steps.unpersist()
    found = out[0] if out else sources.select("k", F.lit(0.0).alias("score")).limit(0)
    for x in out[1:]:
        found = found.unionByName(x)
    return found.groupBy("k").agg(F.sum("score").alias("score"))


def _packed_graph(own: DataFrame, edges: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame] | None:
    """(hashes, neighbours) of ``_hashes`` and ``_adjacency``, or None where two ids share a hash."""
    for ids in (own, None):  # ends that are no nodes are rare, and looking for them takes all edges once more
        if ids is None:
            ids = own.unionByName(edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
        hashes = _hashes(ids)
        if hashes.agg(F.sum("twice")).first()[0]:
            return None
        packed = _adjacency(hashes, edges, tasks)
        if not packed.agg(F.sum("strange")).first()[0]:
            return hashes, packed
    raise AssertionError("edges changed while they were read")


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: int = 100, limit: int = 1000, packed: int = 400_000_000) -> DataFrame:
    """``id, score``: Brandes' betweenness; exact up to ``limit`` nodes, else from ``pivots`` nodes by hash order.

    Nodes are numbered by their hashes. Sources are dealt over tasks, and each task gets all neighbours as packed 32-bit numbers
    through a shuffle, one task for each executor where these are many; the driver holds the sources only. A graph of more than
    ``packed`` neighbours (two for each edge), or with two ids of one 64-bit hash, is walked by joins instead.
    """
    spark = nodes.sparkSession
    own = nodes.select("id").distinct()
    with shuffles_removed(spark):
        n = own.count()
        graph = _packed_graph(own, edges, min(64, spark.sparkContext.defaultParallelism)) if packed else None
        size = 2 * (graph[1].agg(F.sum("n")).first()[0] or 0) if graph else 0
    sources, scale = own, 1.0
    if n > limit:
        sources = sources.orderBy(F.xxhash64("id"), "id").limit(pivots)
        scale = n / min(n, pivots)
    norm = scale / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if not graph or size > packed or n >= 1 << 31:
        found = _by_rows(own, edges, sources)
        return own.join(found, "id", "left").select("id", F.round(F.coalesce(F.col("score") * norm, F.lit(0.0)), 9).alias("score"))
    hashes, lists = graph
    starts, count = {}, 0
    for r in sorted(hashes.select("first", "n").collect()):
        starts[r["first"]], count = count, count + r["n"]

    def unpack(batches):
        for x in batches:
            for first, cells in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                h = np.frombuffer(cells, "<i8")
                for lo in range(0, len(h), 50_000):
                    part = h[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(len(part)) + starts[first] + lo)], ["h", "k"])

    names = hashes.select("first", "hashes").mapInArrow(unpack, "h long, k long")
    with shuffles_removed(spark):
        chosen = sources.where("id is not null").select(F.xxhash64("id").alias("h"))
        ks = sorted(r["k"] for r in names.join(F.broadcast(chosen), "h").select("k").collect())  # at most limit or pivots rows
        executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
        tasks = max(1, min(64, spark.sparkContext.defaultParallelism if size < 1 << 25 else executors, len(ks)))
        found = checkpoint(_packed_sums(lists, ks, count, tasks))
    found = names.join(found, "k").select("h", (F.col("score") * norm).alias("score"))
    return own.join(found, F.when(F.col("id").isNotNull(), F.xxhash64("id")) == F.col("h"), "left").select("id", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


def _by_rows(own: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, score`` of ``_row_sums``, for nodes numbered by name."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().persist()  # read for the names, then for the pairs
    names = numbered(own.unionByName(e.select(F.explode(F.array("u", "v")).alias("id"))).distinct(), ["id"], "k").select("id", "k").persist()
    pairs = e.join(names.select(F.col("id").alias("u"), F.col("k").alias("a")), "u").join(names.select(F.col("id").alias("v"), F.col("k").alias("b")), "v")
    pairs = checkpoint(pairs.select("a", "b"))
    e.unpersist()
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = _row_sums(pairs, checkpoint(sources.join(names, "id").select("k")))
    return names.join(found, "k").select("id", "score")


def edge_betweenness(nodes: DataFrame, edges: DataFrame, max_nodes: int = 5000) -> DataFrame:
    """``u, v, score`` by Brandes over all sources; for graphs of up to ``max_nodes`` nodes."""
    spark = nodes.sparkSession
    n = nodes.select("id").distinct().count()
    if n > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes")
    near: dict[str, list[str]] = {}
    for r in edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().collect():
        near.setdefault(r["u"], []).append(r["v"])
        near.setdefault(r["v"], []).append(r["u"])
    shared = spark.sparkContext.broadcast(near)

    def work(frames):
        adj, total = shared.value, {}
        for pdf in frames:
            for s in pdf["id"]:
                order, sigma, dist, pred = [s], {s: 1.0}, {s: 0}, {s: []}
                for v in order:
                    for w in adj.get(v, ()):
                        if w not in dist:
                            dist[w], sigma[w], pred[w] = dist[v] + 1, 0.0, []
                            order.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] += sigma[v]
                            pred[w].append(v)
                delta = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in pred[w]:
                        c = sigma[v] / sigma[w] * (1 + delta[w])
                        delta[v] += c
                        key = (v, w) if v < w else (w, v)
                        total[key] = total.get(key, 0.0) + c
        if total:
            yield pd.DataFrame([(u, v, x) for (u, v), x in total.items()], columns=["u", "v", "score"])

    norm = n * (n - 1) if n > 1 else 1
    found = nodes.select("id").distinct().repartition(8).mapInPandas(work, "u string, v string, score double")
    return found.groupBy("u", "v").agg(F.round(F.sum("score") / norm, 9).alias("score"))
