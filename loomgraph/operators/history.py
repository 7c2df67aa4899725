"""Commit history and lessons: danger, co-change, warnings, decayed scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T

#: What marks a subject as a fix or a revert, files that say nothing, and thresholds.
FIX = r"(?i)\b(fix|fixes|fixed|bug|hotfix|patch|repair)\b"
REVERT = r"(?i)^revert\b|\brevert(s|ed)?\b"
NOISE = ("package-lock.json", "yarn.lock", "poetry.lock", "Cargo.lock", "go.sum", "CHANGELOG.md", "pnpm-lock.yaml", "uv.lock")
MIN_EDITS, MIN_SUPPORT, MIN_CONFIDENCE, MAX_FILES, PARTNERS, DANGER = 3, 3, 0.5, 50, 8, 0.30


def parse_log(log: DataFrame, *keep: str) -> DataFrame:
    """``commit_id, subject, path`` from ``value``: commits start with U+0001, the subject ends at U+0002, paths by line.

    A commit's number is its place in its row; where there are several logs, the columns ``keep`` tell them apart.
    """
    c = log.select(*keep, F.posexplode(F.split("value", "\x01")).alias("commit_id", "c")).where("c like '%\x02%'")
    c = c.select(*keep, "commit_id", F.split_part("c", F.lit("\x02"), F.lit(1)).alias("subject"), F.split_part("c", F.lit("\x02"), F.lit(2)).alias("files"))
    return c.select(*keep, "commit_id", F.trim("subject").alias("subject"), F.explode(F.split("files", "\n")).alias("path")).where("trim(path) <> ''")


def quiet(commits: DataFrame) -> DataFrame:
    return commits.where(~T.basename(F.col("path")).isin(*NOISE))


def danger(commits: DataFrame, min_edits: int = MIN_EDITS) -> DataFrame:
    """``path, edits, fix_edits, revert_edits, danger``; a revert counts double and isn't a fix too."""
    s = F.col("subject")
    g = commits.groupBy("path").agg(
        F.count(F.lit(1)).alias("edits"),
        F.count_if(s.rlike(FIX) & ~s.rlike(REVERT)).alias("fix_edits"),
        F.count_if(s.rlike(REVERT)).alias("revert_edits"),
    )
    share = F.least(F.lit(1.0), (F.col("fix_edits") + 2 * F.col("revert_edits")) / F.col("edits"))
    return g.withColumn("danger", F.when(F.col("edits") >= min_edits, F.round(share, 3)).otherwise(F.lit(0.0)))


def cochange(commits: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``path, partner, support, confidence`` both ways; only commits of 2 to 50 files pair up, which bounds the pairs."""
    sized = commits.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, MAX_FILES)).select("commit_id")
    files = commits.join(sized, "commit_id", "left_semi").select("commit_id", "path").distinct()
    a, b = files.withColumnRenamed("path", "a"), files.withColumnRenamed("path", "b")
    pairs = a.join(b, "commit_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    edits = commits.groupBy("path").agg(F.count(F.lit(1)).alias("edits"))
    both = pairs.select(F.col("a").alias("path"), F.col("b").alias("partner"), "support").unionByName(pairs.select(F.col("b").alias("path"), F.col("a").alias("partner"), "support"))
    out = both.join(edits, "path").withColumn("confidence", F.round(F.col("support") / F.col("edits"), 6))
    return out.where(F.col("confidence") >= min_confidence).drop("edits")


def partners(couples: DataFrame, top_n: int = PARTNERS) -> DataFrame:
    w = Window.partitionBy("path").orderBy(F.desc("confidence"), F.desc("support"), "partner")
    return couples.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def edit_warnings(plan: DataFrame, scars: DataFrame, couples: DataFrame) -> DataFrame:
    """``path, kind, detail``: dangerous files of a plan (path), and partners that it leaves out."""
    risky = scars.join(plan.select("path"), "path", "left_semi").where(F.col("danger") >= DANGER)
    risky = risky.select("path", F.lit("danger").alias("kind"), F.col("danger").cast("string").alias("detail"))
    missing = couples.join(plan.select("path"), "path", "left_semi").join(plan.select(F.col("path").alias("partner")), "partner", "left_anti")
    return risky.unionByName(missing.select("path", F.lit("partner").alias("kind"), F.col("partner").alias("detail")))


def unique_suffix(paths: DataFrame, query: str) -> DataFrame:
    """``path``: the exact one, else the only one that ends in ``/query``."""
    tier = F.when(F.col("path") == query, 0).when(F.col("path").endswith("/" + query), 1)
    g = paths.select("path", tier.alias("tier")).where("tier is not null").groupBy("tier").agg(F.min("path").alias("path"), F.count_distinct("path").alias("n"))
    return g.where("n = 1").orderBy("tier").limit(1).select("path")


def lesson_scores(marks: DataFrame, now: str, half_life_days: float = 30.0, corroboration: int = 2) -> DataFrame:
    """``node, score, n_pos, n_neg, last, verdict`` from (node, doc, ts, outcome).

    Useful marks add, dead ends and corrections take away, each with its age's weight. Nodes with negative
    marks alone are left out.
    """
    m = marks.select("node", "doc", "ts", F.col("outcome").isin("useful").alias("pos")).distinct()
    age = (F.lit(now).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400.0
    w = T.half_life(age, half_life_days)
    g = m.groupBy("node").agg(
        F.round(F.sum(F.when(F.col("pos"), w).otherwise(-w)), 6).alias("score"),
        F.count_distinct(F.when(F.col("pos"), F.col("doc"))).alias("n_pos"),
        F.count_distinct(F.when(~F.col("pos"), F.col("doc"))).alias("n_neg"),
        F.max("ts").alias("last"),
    ).where("n_pos > 0")
    contested = F.when(F.abs("score") < 1e-6, "contested_even").when(F.col("score") > 0, "contested_useful").otherwise("contested_dead_end")
    verdict = F.when(F.col("n_neg") > 0, contested).when(F.col("n_pos") >= corroboration, "preferred").otherwise("tentative")
    return g.withColumn("verdict", verdict)


def latest_by(marks: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """The last row of each key."""
    best = marks.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("m"))
    return best.select(key, *(F.col(f"m.{c}").alias(c) for c in columns))


def provenance(marks: DataFrame, top_n: int = 5) -> DataFrame:
    """``node, doc, rank``: the latest marks of each node."""
    w = Window.partitionBy("node").orderBy(F.desc("ts"), F.desc("doc"))
    return marks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select("node", "doc", "rank")


def plurality(votes: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key (ties: the smallest)."""
    c = votes.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), value)).alias("m")).select(key, F.col(f"m.{value}").alias(value))
