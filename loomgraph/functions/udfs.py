"""Functions for SQL text: what Spark has no built-in for, under the prefix ``kg_``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from loomgraph.functions import text as X
from loomgraph.operators import entities
from loomgraph.operators.verification import claims_in


class Headings:
    """``level, title`` of a Markdown text."""

    def eval(self, md: str):
        fence = False
        for line in (md or "").split("\n"):
            if line.lstrip().startswith(("```", "~~~")):
                fence = not fence
            elif not fence and line.startswith("#"):
                level = len(line) - len(line.lstrip("#"))
                if level <= 6 and line[level : level + 1] == " ":
                    yield level, line[level:].strip()


class Claims:
    """``subject, relation, object`` of the claims in a text."""

    def eval(self, text: str):
        yield from claims_in(text)


class Slices:
    """``part, body``: a text in pieces of at most ``size`` characters that end at line ends where they can."""

    def eval(self, text: str, size: int):
        text, at, part = text or "", 0, 0
        while at < len(text):
            end = min(len(text), at + size)
            cut = text.rfind("\n", at, end) if end < len(text) else -1
            end = cut + 1 if cut > at else end
            yield part, text[at:end]
            at, part = end, part + 1


def register(spark: SparkSession) -> None:
    """Make ``kg_norm_id``, ``kg_norm_label``, ``kg_jaro``, ``kg_jaro_winkler`` and the tables ``kg_headings``, ``kg_claims``, ``kg_slices`` known."""
    spark.udf.register("kg_norm_id", X.normalize_id_udf)
    spark.udf.register("kg_norm_label", X.norm_label_udf)
    spark.udf.register("kg_jaro", entities.jaro_udf)
    spark.udf.register("kg_jaro_winkler", entities.jaro_winkler_udf)
    spark.udtf.register("kg_headings", udtf(Headings, returnType="level int, title string"))
    spark.udtf.register("kg_claims", udtf(Claims, returnType="subject string, relation string, object string"))
    spark.udtf.register("kg_slices", udtf(Slices, returnType="part int, body string"))
