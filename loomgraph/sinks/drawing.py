"""Drawings of a graph: a canvas of cards in boxes by community, and the elements of an SVG picture.

Places come from distributed numbering, so that neither a large community nor many of them meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import degree
from loomgraph.runtime import checkpoint, numbered

# Sizes of cards and boxes, the gaps between them, colours of boxes, and how many edges a canvas shows.
CARD, CARD_GAP, MARGIN, TITLE = (180, 60), 20, 20, 80
BOX, BOX_GAP, BOX_STEP, BOX_PAD = (600, 400), 80, (220, 100), 120
COLOURS, CANVAS_EDGES = 6, 200


def _columns(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("long")


def canvas_boxes(nodes: DataFrame) -> DataFrame:
    """``community, n, x, y, width, height, color`` of (id, label, community): boxes in a grid as wide as it is high."""
    sizes = checkpoint(nodes.groupBy("community").agg(F.count(F.lit(1)).alias("n")))
    across = max(1, math.ceil(math.sqrt(sizes.count())))
    cols = _columns(F.col("n"))
    box = numbered(sizes, ["community"], "_k").select(
        "community", "n", (F.col("_k") % across).alias("_c"), F.floor(F.col("_k") / across).alias("_r"),
        F.greatest(F.lit(BOX[0]), BOX_STEP[0] * cols).alias("width"),
        F.greatest(F.lit(BOX[1]), BOX_STEP[1] * F.ceil(F.col("n") / cols) + BOX_PAD).alias("height"),
        (F.col("_k") % COLOURS + 1).cast("string").alias("color"),
    )

    def starts(line: str, size: str, name: str) -> DataFrame:
        # one row for each line of the grid: the root of the number of communities
        widest = box.groupBy(line).agg(F.max(size).alias("_s"))
        before = F.coalesce(F.sum("_s").over(Window.orderBy(line).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return widest.select(line, (before + BOX_GAP * F.col(line)).alias(name))

    out = box.join(starts("_c", "width", "x"), "_c").join(starts("_r", "height", "y"), "_r")
    return out.select("community", "n", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "width", "height")), "color")


def canvas_cards(nodes: DataFrame) -> DataFrame:
    """``id, community, x, y`` of (id, label, community): cards by label in their community's box."""
    boxes = canvas_boxes(nodes)
    n = numbered(nodes.select("id", "label", "community"), ["community", "label", "id"], "_k")
    first = n.groupBy("community").agg(F.min("_k").alias("_first"))
    j = n.join(first, "community").join(boxes.withColumnsRenamed({"x": "_x", "y": "_y"}), "community")
    k, cols = F.col("_k") - F.col("_first"), _columns(F.col("n"))
    return j.select(
        "id", "community",
        (F.col("_x") + MARGIN + (k % cols) * (CARD[0] + CARD_GAP)).alias("x"),
        (F.col("_y") + TITLE + F.floor(k / cols) * (CARD[1] + CARD_GAP)).alias("y"),
    )


def canvas_edges(edges: DataFrame) -> DataFrame:
    """``src, dst, label`` of the 200 heaviest edges; of equal ones those with smaller ids."""
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    tag = F.concat(F.lit("["), F.coalesce("confidence", F.lit("EXTRACTED")), F.lit("]"))
    e = edges.select("src", "dst", "relation", weight.alias("_w"), F.concat_ws(" ", F.nullif("relation", F.lit("")), tag).alias("label"))
    return e.orderBy(F.desc("_w"), "src", "dst", "relation").limit(CANVAS_EDGES).select("src", "dst", "label")


def svg(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``line``: lines and circles of a picture, between its header and footer; radius by degree, places of the canvas."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    d = degree(nodes, edges)
    top = d.agg(F.greatest(F.lit(1), F.max("degree")).alias("_top"))  # one row
    at = checkpoint(canvas_cards(nodes).join(d, "id").join(nodes.select("id", "label"), "id").join(F.broadcast(top)))
    dot = at.select(F.format_string('<circle cx="%d" cy="%d" r="%.1f"><title>%s</title></circle>', "x", "y", (5 + 20 * F.col("degree") / F.col("_top")).cast("double"), esc(F.col("label"))).alias("line"))
    ends = edges.join(at.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1")), "src").join(at.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2")), "dst")
    dash = F.when(F.coalesce("confidence", F.lit("EXTRACTED")) != "EXTRACTED", ' stroke-dasharray="4"').otherwise("")
    return ends.select(F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d"%s/>', "x1", "y1", "x2", "y2", dash).alias("line")).unionByName(dot)
