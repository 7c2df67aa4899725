"""MinHash near-duplicates by a signature-coordinate inverted join.

Equal word sequences collapse to one representative first. Each representative has K minimum
hashes and posts itself under its coordinate-value pairs. Two passes follow:

1. Every list has a leader, its smallest id. For each document the collisions with every leader
   are counted by merging its lists; with the leader of T or more it is compared on full sets. Whatever links
   is collapsed, which takes one comparison a document for a group of near copies of any size.
2. A pair that agrees in T of K coordinates must meet in one of the K-T+1 rarest lists (the prefix); the longest
   are skipped. Where two documents that pass one has not connected meet, the agreements are counted over the
   whole signatures, in one list for each pair; pairs with T or more are retained and compared on full sets.

Full sets are of real words: no hash decides a link. Work is handed on as units of documents that candidate
pairs connect within one list, so a chain of half-similar documents stays as many small units. Every
worker returns a spanning forest of what it has found, never all pairs of a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.grouping import forest, runs, unused, whole_runs
from loomgraph.llm.words import Batch, U, list_array, mix, text_chunks, windows
from loomgraph.operators.components import connected_components
from loomgraph.runtime import checkpoint, materialise, shuffle_partitions

#: Words in a shingle.
SHINGLE = 5
#: Signature coordinates and the agreements asked for. At a similarity of 0.75 fewer than 12 of 32
#: agree with a probability of 4e-6.
COORDINATES, AGREE = 32, 12
#: Rows of a posting list that meet in one task, documents of a unit around a leader, and shingles of a unit.
LIST_BLOCK, STAR, SET_BLOCK = 1024, 256, 1_000_000

_SALT = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, Batch]:
    """(hashes, offsets, batch): the distinct shingle hashes of each text, ascending.

    A text of 1 to width-1 words has its whole sequence as its one shingle; none without words.
    """
    b = Batch(texts, lower=True)
    at, h = b.windows(width)
    doc = b.doc[at]
    for i in np.flatnonzero((b.n_words > 0) & (b.n_words < width)):
        x = windows(b.hash[b.first[i] : b.first[i + 1]], int(b.n_words[i]), salt=1)
        doc, h = np.append(doc, i), np.append(h, x)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[keep], h[keep]
    return h, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts))))), b


def signatures(h: np.ndarray, offsets: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Row i: k 32-bit minima of set i; sets without members get zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, k), np.int64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        for c in range(k):
            z = (h ^ _SALT[(c + 97) % 256]) * _SALT[c]
            out[full, c] = (np.minimum.reduceat(z ^ (z >> U(32)), offsets[full]) >> U(31)).astype(np.int64)
    return out


def _describe(batches):
    for part in text_chunks(batches):
        h, off, b = shingle_sets(part.column("text").to_pylist())
        keys = signatures(h, off) + (np.arange(COORDINATES, dtype=np.int64) << 33)
        ends = b.offset.tolist()
        digest = [hashlib.sha256(b" ".join(b.data[lo : hi - 1].split())).digest()[:16] for lo, hi in zip(ends, ends[1:])]
        lists = list_array(keys.ravel(), np.full(len(keys), COORDINATES))
        arrays = [part.column("doc_id"), pa.array(digest, pa.binary()), pa.array(np.diff(off)), lists]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "n_shingles", "keys"])


def _units(rep, size, key, half, i, j):
    """(unit, half, rep): rows of one list that candidate pairs i-j connect make a unit, whose sets are compared.

    A unit of more than SET_BLOCK shingles is cut into block pairs, each a unit of its own.
    """
    low, root = forest(i, j)
    rows = np.concatenate((low, np.unique(root)))
    root = np.concatenate((root, np.unique(root)))
    order = np.lexsort((rows, root))
    rows, root = rows[order], root[order]
    unit = mix(mix(key[root].astype(np.uint64)) ^ (rep[root].astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    cut = np.flatnonzero(np.diff(root)) + 1
    total = np.add.reduceat(size[rows], np.concatenate(([0], cut)))
    big = np.repeat(total > SET_BLOCK, np.diff(np.concatenate(([0], cut, [len(rows)]))))
    out = [(unit[~big], np.zeros((~big).sum(), np.int64), rep[rows[~big]])]
    for r in np.unique(root[big]):
        at = np.flatnonzero(root == r)
        block = np.cumsum(size[rows[at]]) // SET_BLOCK
        parts = [at[block == k] for k in np.unique(block)]
        for x, left in enumerate(parts):
            for y, right in enumerate(parts[x:], x):
                both = left if x == y else np.concatenate((left, right))
                u = mix(unit[both] + U(x * len(parts) + y + 1))
                out.append((u, (np.arange(len(both)) >= len(left)).astype(np.int64), rep[rows[both]]))
    u, h, r = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array((u >> U(1)).astype(np.int64)), pa.array(h), pa.array(r)], ["unit", "half", "rep"])


def _meet(batches):
    """Units of rows to be compared: pairs of one list that agree in AGREE coordinates and whose sizes allow a link.

    A pair that shares several lists counts in the list of its first common prefix coordinate. Pairs
    that are connected already are skipped.
    """

    def found(t: pa.Table):
        key, coord = t["key"].to_numpy(), t["coord"].to_numpy()
        rep, size, label = t["rep"].to_numpy(), t["n_shingles"].to_numpy(), t["label"].to_numpy()
        half, mask = t["half"].to_numpy(), t["mask"].to_numpy()
        sig = t["keys"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        bit = np.int64(1) << np.arange(sig.shape[1], dtype=np.int64)
        a, b = [], []
        n = len(rep)
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        length = np.diff(np.concatenate(([0], cut, [n])))
        group = np.repeat(np.arange(len(length)), length)
        wide = length[group] > 64

        def keep(i, j):
            ok = np.minimum(size[i], size[j]) * 100 >= 75 * np.maximum(size[i], size[j])
            ok &= label[i] != label[j]
            i, j = i[ok], j[ok]
            same = sig[i] == sig[j]
            ok = same.sum(1) >= AGREE
            i, j, same = i[ok], j[ok], same[ok]
            shared = (same * bit).sum(1) & mask[i] & mask[j]
            ok = (shared & -shared) == bit[coord[i]]
            return i[ok], j[ok]

        for d in range(1, min(64, length.max())):
            i = np.flatnonzero(~wide[:-d] & (group[:-d] == group[d:]))
            if not len(i):
                break
            i, j = keep(i, i + d)
            a.append(i)
            b.append(j)
        for g in np.flatnonzero(length > 64):
            at = np.flatnonzero(group == g)
            left, right = at[half[at] == 0], at[half[at] == 1]
            other = right if len(right) else left
            tree = []
            for lo in range(0, len(left), 64):
                i, j = np.meshgrid(left[lo : lo + 64], other, indexing="ij")
                i, j = i.ravel(), j.ravel()
                if not len(right):
                    i, j = i[i < j], j[i < j]
                tree.append(forest(*keep(i, j)))
            x, y = forest(*(np.concatenate(z) for z in zip(*tree)))
            a.append(x)
            b.append(y)
        i, j = (np.concatenate(a), np.concatenate(b)) if a else (rep[:0], rep[:0])
        return _units(rep, size, key, half, i, j) if len(i) else None

    for t in whole_runs(batches, "key"):
        out = found(t)
        if out is not None:
            yield out


def _numbered(values: np.ndarray) -> np.ndarray:
    """Values replaced by dense numbers that only equal ones share."""
    order = np.argsort(values, kind="stable")
    new = np.zeros(len(values), np.int64)
    new[1:] = values[order][1:] != values[order][:-1]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(new)
    return out


def exact_sets(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets) of each text's distinct shingles, ascending; equal numbers mean equal words, without hashing."""
    b = Batch(texts, lower=True)
    w = b.ids
    n = len(w) - width + 1
    at = np.zeros(0, np.int64)
    num = at
    if n > 0:
        num = w[:n]
        for k in range(1, width):
            num = _numbered(num * np.int64(len(w) + 1) + w[k : k + n])
        at = np.flatnonzero(b.doc[:n] == b.doc[width - 1 :])
        num = num[at]
    doc = b.doc[at]
    short: dict[tuple, int] = {}
    few = np.flatnonzero((b.n_words > 0) & (b.n_words < width))
    own = [short.setdefault(tuple(w[b.first[i] : b.first[i + 1]].tolist()), -1 - len(short)) for i in few]
    doc, num = np.concatenate((doc, few)), np.concatenate((num, np.array(own, np.int64)))
    order = np.lexsort((num, doc))
    doc, num = doc[order], num[order]
    keep = np.ones(len(num), bool)
    keep[1:] = (num[1:] != num[:-1]) | (doc[1:] != doc[:-1])
    return num[keep], np.concatenate(([0], np.cumsum(np.bincount(doc[keep], minlength=len(texts)))))


def _intersections(h: np.ndarray, off: np.ndarray, left: int):
    """(i, j, common) for i < left and j >= left (left = 0: for all i < j) by scanning and counting."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], doc[order]
    new = np.concatenate(([True], hs[1:] != hs[:-1])) if len(hs) else np.zeros(0, bool)
    gid = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(hs))
    back = np.empty(len(h), np.int64)
    back[order] = gid
    for i in range(left or n):
        g = back[off[i] : off[i + 1]]
        g = g[end[g] - start[g] > 1]
        ln = end[g] - start[g]
        total = int(ln.sum())
        if not total:
            continue
        idx = np.repeat(start[g] - np.concatenate(([0], np.cumsum(ln)[:-1])), ln) + np.arange(total)
        common = np.bincount(ds[idx], minlength=n)
        common[: left or i + 1] = 0
        j = np.flatnonzero(common)
        if len(j):
            yield i, j, common[j]


def _confirm(batches):
    """Links within each unit (between its halves, where it has two) on full sets of real words, as a forest."""
    for t in runs(batches, ["unit", "part"]):
        t = t.sort_by([("half", "ascending"), ("rep", "ascending")])
        rep, half = t["rep"].to_numpy(), t["half"].to_numpy()
        left = int((half == 0).sum()) if half.any() else 0
        if left == len(rep) or len(rep) < 2:
            continue
        h, off = exact_sets(t["text"].to_pylist())
        size = np.diff(off)
        a, b = [], []
        for i, j, common in _intersections(h, off, left):
            ok = 100 * common >= 75 * (size[i] + size[j] - common)
            ok &= rep[j] != rep[i]
            if ok.any():
                b.append(rep[j[ok]])
                a.append(np.full(int(ok.sum()), rep[i]))
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["src", "dst"])


def _confirmed(units: DataFrame, texts: DataFrame) -> DataFrame:
    """``src, dst``: links found in units (unit, part, half, rep), whose texts are joined to them."""
    rows = units.join(texts, "rep").select("unit", "part", "half", "rep", "text")
    dealt = rows.repartition(shuffle_partitions(units.sparkSession), "unit", "part").sortWithinPartitions("unit", "part")
    return dealt.mapInArrow(_confirm, "src long, dst long")


def _stars(ranked: DataFrame) -> DataFrame:
    """Units of documents that share AGREE lists or more with the same leader, at most about STAR to a unit."""
    counted = ranked.withColumn("ls", F.expr("filter(transform(p, x -> x.leader), l -> l <> rep)")).withColumn(
        "best",
        F.expr("array_max(transform(array_distinct(ls), l -> struct(size(filter(ls, x -> x = l)) as n, -l as l)))"),
    )
    led = counted.where(f"best.n >= {AGREE}").select(F.expr("-best.l").alias("unit"), "rep", "n_shingles")
    parts = led.groupBy("unit").agg(
        F.expr(f"cast(ceil(greatest(count(1) / {STAR}, sum(n_shingles) / {SET_BLOCK})) as int)").alias("nb")
    )
    members = led.join(parts, "unit").select("unit", F.expr("cast(pmod(xxhash64(rep), nb) as int)").alias("part"), "rep")
    heads = parts.select("unit", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("part"), F.col("unit").alias("rep"))
    return members.unionByName(heads).withColumn("half", F.lit(0).cast("long"))


def _lists(ranked: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the lists in which documents of different labels meet, cut into blocks.

    The rows of a long list's most frequent label need not meet one another: they meet the rest only,
    so that a group that is connected already costs a shuffle of its rows, not of their pairs.
    """
    posts = (
        ranked.withColumn("q", F.explode("q"))
        .select("cid", "rep", "n_shingles", "mask", F.col("q.key").alias("key"))
        .join(labels, "rep", "left")
        .withColumn("label", F.coalesce("label", "rep"))
    )
    per = posts.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    lists = (
        per.groupBy("key")
        .agg(F.sum("n").alias("m"), F.max("n").alias("d"), F.max_by("label", F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1")
        .selectExpr("key", "m", "most", f"cast(ceil(d / {LIST_BLOCK}) as int) as nd", f"cast(ceil((m - d) / {LIST_BLOCK}) as int) as ns")
    )
    placed = posts.join(lists, "key").withColumn("own", F.expr("cast(pmod(xxhash64(rep, key), if(label = most, nd, ns)) as int)"))
    units = f"""
      case when m <= {LIST_BLOCK} then array(struct(0 as bi, 0 as bj, 0L as half))
           when label = most then transform(sequence(0, ns - 1), i -> struct(i as bi, -1 - own as bj, 1L as half))
           else concat(transform(sequence(0, nd - 1), j -> struct(own as bi, -1 - j as bj, 0L as half)),
                       transform(sequence(0, ns - 1), o -> struct(least(o, own) as bi, greatest(o, own) as bj, cast(o < own as long) as half)))
      end"""
    return (
        placed.withColumn("u", F.explode(F.expr(units)))
        .select(
            "cid", "rep", "n_shingles", "mask", "label", F.expr("u.half").alias("half"), F.expr("cast(shiftright(key, 33) as int)").alias("coord"),
            F.expr(f"case when m <= {LIST_BLOCK} then key else xxhash64(key, u.bi, u.bj) end").alias("key"),
        )
        .join(classes.select("cid", "keys"), "cid")
        .drop("cid")
    )


def minhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (doc_id, text, ...).

    Links: Jaccard similarity of the 5-word shingle sets (A-Z lower-cased) of 0.75 or more. A null
    or wordless text has an empty set and links with nothing, not even its equals. Equal texts are
    one component whose id is the smallest doc_id. Rows that share a doc_id are one document; each
    still gets its row. Rows with a null doc_id are kept as components of their own with a null id.
    An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    desc = checkpoint(
        docs.mapInArrow(_describe, "doc_id long, digest binary, n_shingles long, keys array<long>")
    )
    classes = (
        desc.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    )
    classes = checkpoint(classes.withColumn("cid", F.monotonically_increasing_id()))
    posts = classes.select("cid", "rep", "n_shingles", F.explode("keys").alias("key"))
    lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("rep").alias("leader")).where("df > 1")
    # The prefix: coordinates that nobody shares come first in the order, then the rarest lists.
    prefix = COORDINATES - AGREE + 1
    ranked = checkpoint(
        posts.join(lists, "key")
        .groupBy("cid", "rep", "n_shingles")
        .agg(F.array_sort(F.collect_list(F.struct("df", "key", "leader"))).alias("p"))
        .where(F.size("p") >= AGREE)
        .withColumn("q", F.expr(f"slice(p, 1, greatest(0, {prefix} - ({COORDINATES} - size(p))))"))
        .withColumn("mask", F.expr("aggregate(q, 0L, (m, x) -> m | shiftleft(1L, cast(shiftright(x.key, 33) as int)))"))
    )
    sharing = ranked.select("rep").distinct()
    texts = materialise(docs.join(sharing, docs.doc_id == sharing.rep).select("rep", "text"))
    # Pass one links documents with the leader of most of their lists, and so collapses groups of near copies.
    first = connected_components(_confirmed(_stars(ranked), texts))
    labels = checkpoint(first.select(F.col("node").alias("rep"), F.col("component").alias("label")))
    # Pass two counts agreements of pairs that pass one has not connected.
    n = shuffle_partitions(docs.sparkSession)
    met = _lists(ranked, classes, labels).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet, "unit long, half long, rep long")
    found = _confirmed(met.withColumn("part", F.lit(0)), texts)
    comps = connected_components(labels.select(F.col("rep").alias("src"), F.col("label").alias("dst")).unionByName(found))
    joined = (
        desc.select("doc_id", "digest", "n_shingles")
        .join(classes.select("digest", "rep"), "digest", "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    )
    by_row = joined.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id"))
        .otherwise(F.col("doc_id"))
        .alias("component_id"),
    )
    return by_row.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates_removed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) without those whose component keeps another document.

    One row survives of each component: of rows that share the kept doc_id the one with the smallest hash of its
    text. Rows without a doc_id all stay, since nothing tells them apart.
    """
    kept_id, copy = unused(docs, "_kept_id"), unused(docs, "_copy")
    keep = minhash_components(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias(kept_id)).distinct()
    kept = docs.join(keep, docs["doc_id"].cast("long") == keep[kept_id], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    kept = kept.withColumn(copy, first).where(F.col(copy) == 1).drop(copy)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
