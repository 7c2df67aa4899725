"""Upserts into a graph database, partition by partition, in batches of parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, NumericType, StringType


def _scalars(df: DataFrame) -> list[str]:
    """Columns that a property can hold; names that start with ``_`` stay here."""
    return [f.name for f in df.schema if isinstance(f.dataType, (StringType, NumericType, BooleanType)) and not f.name.startswith("_")]


def push(nodes: DataFrame, edges: DataFrame, connect: Callable, batch: int = 1000) -> None:
    """Send nodes, then edges. ``connect()`` gives a session with ``run(statement, rows)`` and ``close()`` in a worker.

    Statements are MERGEs, so a partition that runs again after a loss changes nothing. Labels and relations keep
    letters, digits and underscores; values only travel as parameters. Null properties are left out.
    """
    def sender(key: str, kind: Callable, statement: Callable, names: list[str], fixed: tuple[str, ...]):
        def work(rows):
            session, waiting = connect(), {}
            try:
                for r in rows:
                    props = {c: r[c] for c in names if r[c] is not None and c not in fixed}
                    group = waiting.setdefault(kind(r[key]), [])
                    group.append({**{c: r[c] for c in fixed}, "props": props})
                    if len(group) >= batch:
                        session.run(statement(kind(r[key])), group)
                        waiting[kind(r[key])] = []
                for k, group in waiting.items():
                    if group:
                        session.run(statement(k), group)
            finally:
                session.close()

        return work

    label = lambda t: re.sub(r"[^A-Za-z0-9_]", "", (t or "").capitalize()) or "Entity"
    relation = lambda t: re.sub(r"[^A-Z0-9_]", "_", (t or "").upper()) or "RELATED_TO"
    nodes.foreachPartition(sender("file_type", label, lambda k: f"UNWIND $rows AS r MERGE (n:{k} {{id: r.id}}) SET n += r.props", _scalars(nodes), ("id",)))
    edges.foreachPartition(
        sender("relation", relation, lambda k: f"UNWIND $rows AS r MATCH (a {{id: r.src}}), (b {{id: r.dst}}) MERGE (a)-[e:{k}]->(b) SET e += r.props", _scalars(edges), ("src", "dst"))
    )
