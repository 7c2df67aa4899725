"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of each whole text go through cosine features that approximate a Gaussian kernel. The
normal equations are summed within each partition, then over partitions; ridge scores follow,
and an isotonic fit on rows that the ridge has not seen turns scores into probabilities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import Batch, list_array, text_chunks
from loomgraph.runtime import checkpoint

#: Random features, kernel width in standard deviations, ridge penalty for each training row.
FEATURES, WIDTH, PENALTY = 256, 4.0, 1e-3
#: Bins of raw scores for the isotonic fit, and the share of partial sums merged in one go.
BINS, FAN_IN = 2048, 64
#: Partial sums at most, so that a merge of one FAN_IN-th of them stays small.
MAX_PARTIALS = 1024
SEED = 20240229
#: Score at which a document counts as good.
BAR = 0.7

STATS = (
    "log_words", "log_chars", "word_length", "upper", "digit", "punct", "symbol", "high", "line_words",
    "sentence_words", "distinct_words", "distinct_lines", "top_word", "end_marks", "pipes", "upper_words",
    "symbol_words", "number_words", "short_words", "long_words", "repeat_bigrams", "log_top_bigram",
)

_CLASS = np.zeros((7, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [ord(c) for c in ".,;:'\"()-"]] = True
_CLASS[3, [ord(c) for c in "!?#$%&*+/<=>@[\\]^_`{|}~"]] = True
_CLASS[4, 128:] = True
_CLASS[5, [ord(c) for c in ".!?"]] = True
_CLASS[6, ord("|")] = True


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATS for each text; a null text is an empty one, and all its rates are 0."""
    b = Batch(texts)
    n = len(texts)
    raw = np.frombuffer(b.data, np.uint8)
    edge = b.offset[:-1]
    size = np.maximum(1, np.diff(b.offset) - 1)

    def per_doc(flags):
        c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return c[np.minimum(b.offset[1:] - 1, len(flags))] - c[np.minimum(edge, len(flags))]

    counts = [per_doc(k[raw]) for k in _CLASS]
    words = np.maximum(1, b.n_words)
    has = [np.concatenate(([0], np.cumsum(k[raw], dtype=np.int64))) for k in (_CLASS[0], _CLASS[1], _CLASS[3])]
    length = b.end - b.start
    inside = [c[b.end] - c[b.start] for c in has]

    def by_word(flags):
        return np.bincount(b.doc, weights=flags, minlength=n)

    def spread(doc, h):
        """Distinct values and the largest count in each document."""
        order = np.lexsort((h, doc))
        d, x = doc[order], h[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
        start = np.flatnonzero(new)
        times = np.diff(np.append(start, len(x)))
        top = np.zeros(n)
        np.maximum.at(top, d[start], times)
        return np.bincount(d[start], minlength=n), top

    distinct, top = spread(b.doc, b.hash)
    at, pair = b.windows(2)
    pairs = np.bincount(b.doc[at], minlength=n)
    distinct_pairs, top_pair = spread(b.doc[at], pair)
    lines = [(t or "").split("\n") for t in texts]
    n_lines = np.array([len(x) for x in lines])
    distinct_lines = np.array([len(set(x)) for x in lines])
    out = np.stack(
        [
            np.log1p(b.n_words), np.log1p(size), np.minimum(30, by_word(length) / words),
            counts[0] / size, counts[1] / size, counts[2] / size, counts[3] / size, counts[4] / size,
            np.log1p(b.n_words / n_lines), np.log1p(b.n_words / (1 + counts[5])), distinct / words,
            distinct_lines / n_lines, top / words, counts[5] / words, counts[6] / words,
            by_word(inside[0] >= np.maximum(2, length // 2)) / words, by_word(inside[2] > 0) / words,
            by_word(inside[1] * 2 > length) / words, by_word(length <= 2) / words, by_word(length > 16) / words,
            1 - distinct_pairs / np.maximum(1, pairs), np.log1p(top_pair),
        ],
        1,
    )
    out[b.n_words == 0] = 0
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` (array of STATS) for each row of ``docs``."""

    def work(batches):
        for part in text_chunks(batches):
            x = statistics(part.column("text").to_pylist())
            arrays = [part.column("doc_id"), list_array(x.ravel(), np.full(len(x), x.shape[1]))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "x"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(work, "doc_id long, x array<double>")


class Model:
    """Scaling, random features, ridge weights and the isotonic steps; a few kilobytes."""

    def __init__(self, mean: np.ndarray, std: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(len(mean), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.steps, self.levels = np.zeros(0), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        phi = np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES)
        return np.concatenate((phi, np.ones((len(x), 1))), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.beta, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between the isotonic levels the score is interpolated, which keeps it rising."""
        r = self.raw(x)
        return np.interp(r, self.steps, self.levels) if len(self.steps) else np.full(len(r), self.levels[0])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing least-squares fit (pool adjacent violators) to y sorted by x."""
    level, weight, span = [], [], []
    for v, k in zip(y, w):
        level.append(v)
        weight.append(k)
        span.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            k2 = weight[-1] + weight[-2]
            level[-2] = (level[-1] * weight[-1] + level[-2] * weight[-2]) / k2
            weight[-2], span[-2] = k2, span[-1] + span[-2]
            del level[-1], weight[-1], span[-1]
    return np.repeat(level, span)


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["x"].to_numpy()).astype(float)


def _partials(model: Model):
    """One row for each partition: upper-left normal equations of its rows as bytes."""

    def work(frames):
        d = FEATURES + 2
        total = np.zeros((d, d))
        for pdf in frames:
            if len(pdf):
                m = np.concatenate((model.features(_matrix(pdf)), pdf["y"].to_numpy(float)[:, None]), 1)
                total += m.T @ m
        if total[-2, -2]:
            yield pd.DataFrame({"slot": [0], "s": [total.tobytes()]})

    return work


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    d = FEATURES + 2
    total = np.zeros((d, d))
    for s in sorted(pdf["s"]):
        total += np.frombuffer(s).reshape(d, d)
    return pd.DataFrame({"slot": pdf["slot"][:1], "s": [total.tobytes()]})


def fit(train: DataFrame) -> Model:
    """A model from ``x, y, fold`` rows: ridge on folds 0 and 1, isotonic on fold 3.

    Means, deviations, normal equations and score bins cover all rows given. What reaches the driver
    is bounded: at most FAN_IN merged matrices of 0.5 MB and BINS bins. Without rows, or with labels
    of one kind only, every score is that share (0.5 without rows).
    """
    k = len(STATS)
    stats = train.agg(
        *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)),
        *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)),
        F.avg("y").alias("y"),
    ).first()
    if stats["y"] is None:
        return Model(np.zeros(k), np.ones(k))
    model = Model(np.array([stats[f"m{i}"] for i in range(k)]), np.array([stats[f"s{i}"] for i in range(k)]))
    model.levels = np.array([float(stats["y"])])
    fitted = train.where("fold <> 3")
    parts = (
        fitted.select("x", "y")
        .coalesce(MAX_PARTIALS)
        .mapInPandas(_partials(model), "slot int, s binary")
        .withColumn("slot", F.expr(f"cast(pmod(xxhash64(s), {FAN_IN}) as int)"))
        .groupBy("slot")
        .applyInPandas(_merge, "slot int, s binary")
        .collect()
    )
    if not parts:
        return model
    total = np.zeros((FEATURES + 2, FEATURES + 2))
    for row in sorted(parts, key=lambda r: r["slot"]):
        total += np.frombuffer(bytes(row["s"])).reshape(total.shape)
    n = total[-2, -2]
    a = total[:-1, :-1] + np.diag([PENALTY * n] * FEATURES + [0.0])
    model.beta = np.linalg.solve(a + 1e-9 * n * np.eye(len(a)), total[:-1, -1])

    def binned(frames):
        for pdf in frames:
            if len(pdf):
                r = model.raw(_matrix(pdf))
                yield pd.DataFrame({"bin": np.floor((r + 0.5) / 2 * BINS).astype(int), "r": r, "y": pdf["y"].to_numpy(float)})

    rows = (
        train.where("fold = 3")
        .select("x", "y")
        .mapInPandas(binned, "bin int, r double, y double")
        .groupBy("bin")
        .agg(F.avg("r").alias("r"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
        .orderBy("bin")
        .collect()
    )
    if len(rows) >= 2:
        r = np.array([x["r"] for x in rows])
        n = np.array([float(x["n"]) for x in rows])
        y = np.array([x["y"] for x in rows])
        # half a row of the overall share in each end keeps the outermost scores off 0 and 1
        model.steps, model.levels = r, np.clip(isotonic(r, y / n, n), 0.5 / n.sum(), 1 - 0.5 / n.sum())
    return model


def fold_of(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.expr(f"cast(crc32(cast({doc_id} as string)) % 4 as int)")


def trained(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from the statistics of all documents that have a label and aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    known = known.where("y in (0, 1)").withColumn("fold", fold_of()).where("fold <> 2")
    return fit(checkpoint(stats.join(known, "doc_id").select("x", "y", "fold")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    ``labels`` (doc_id, quality) teaches from rows that aren't held out; null or other values than 0
    and 1 teach nothing, and of contradicting labels of an id both count. Empty and null texts are
    scored like any others; repeated rows each get their score. A null doc_id is not held out. An empty table
    gives no rows. Other columns are ignored.
    """
    stats = checkpoint(document_statistics(docs))
    model = trained(stats, labels)

    def scored(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return (
        stats.mapInArrow(scored, "doc_id long, score double")
        .withColumn("held_out", F.coalesce(fold_of() == 2, F.lit(False)))
        .withColumn("predicted", (F.col("score") >= BAR).cast("int"))
        .select("doc_id", "held_out", "score", "predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns, of any names) that the classifier does not reject.

    The decision falls on each row by its own text, in the pass that carries the row: null and repeated ids change
    nothing. An empty table gives no rows.
    """
    model = trained(document_statistics(docs), labels)

    def work(batches):
        for part in text_chunks(batches):
            yield part.filter(pa.array(model.score(statistics(part.column("text").to_pylist())) >= BAR))

    src = docs.withColumn("text", F.col("text").cast("string"))
    return src.mapInArrow(work, ", ".join(f"`{c}` {t}" for c, t in src.dtypes))
