"""Manifests and catalogs as graphs: packages, crates, services, database schemas, symbol indexes, shebangs."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import normalize_id

#: Files that declare packages.
MANIFESTS = ("pyproject.toml", "go.mod", "pom.xml", "apm.yml", "package.json", "Cargo.toml")
#: Bytes of a service configuration and servers in it, at most.
MCP_BYTES, MCP_SERVERS = 1 << 20, 200
FRAGMENT = "path string, src string, dst string, relation string, label string"


def packages(path: str, text: str) -> tuple[str | None, list[str]]:
    """(name, dependencies) that a manifest declares."""
    name = path.rsplit("/", 1)[-1]
    if name == "pyproject.toml":
        p = tomllib.loads(text).get("project", {})
        return p.get("name"), [re.match(r"[A-Za-z0-9._-]+", d)[0] for d in p.get("dependencies", [])]
    if name == "go.mod":
        mod = re.search(r"^module\s+(\S+)", text, re.M)
        block = "\n".join(re.findall(r"require\s*\((.*?)\)", text, re.S) + re.findall(r"^require\s+([^(\n].*)$", text, re.M))
        return mod and mod[1], re.findall(r"^\s*(\S+)\s+v", block, re.M)
    if name == "pom.xml":
        body = re.sub(r"<dependencies>.*?</dependencies>|<parent>.*?</parent>", "", text, flags=re.S)
        own = re.search(r"<artifactId>([^<]+)<", body)
        deps = re.findall(r"<dependency>.*?<artifactId>([^<]+)<", text, re.S)
        return own and own[1], deps
    if name == "package.json":
        p = json.loads(text)
        return p.get("name"), [*p.get("dependencies", {}), *p.get("devDependencies", {})]
    if name == "Cargo.toml":
        p = tomllib.loads(text)
        return p.get("package", {}).get("name"), list(p.get("dependencies", {}))
    if name == "apm.yml":
        own = re.search(r"^name:\s*(\S+)", text, re.M)
        deps = re.search(r"^dependencies:\s*\n((?:[ \t]+.*\n?)*)", text, re.M)
        return own and own[1], re.findall(r"^\s*-\s*([\w./-]+)", deps[1], re.M) if deps else []
    return None, []


def package_edges(files: DataFrame, internal_only: bool = False, relation: str = "depends_on") -> DataFrame:
    """``path, src, dst, relation, label`` of (path, text) manifests; with ``internal_only`` targets must be declared too."""
    def work(frames):
        for pdf in frames:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    name, deps = packages(path, text or "")
                except (ValueError, tomllib.TOMLDecodeError):
                    continue
                if name:
                    me = f"pkg_{normalize_id(name)}"
                    rows += [(path, me, f"pkg_{normalize_id(d)}", relation, name) for d in dict.fromkeys(deps)] or [(path, me, None, relation, name)]
            yield pd.DataFrame(rows, columns=["path", "src", "dst", "relation", "label"])

    wanted = files.where(F.substring_index("path", "/", -1).isin(*MANIFESTS))
    out = wanted.select("path", "text").mapInPandas(work, FRAGMENT)
    if not internal_only:
        return out
    known = out.select(F.col("src").alias("dst")).distinct()
    return out.join(known, "dst", "left_semi").select("path", "src", "dst", "relation", "label")


def crate_edges(files: DataFrame) -> DataFrame:
    """Dependencies between the crates of a workspace."""
    return package_edges(files.where("path like '%Cargo.toml'"), True, "crate_depends_on")


def service_edges(files: DataFrame) -> DataFrame:
    """``path, src, dst, relation, label``: servers of service configurations, their packages and environment variables."""
    def work(frames):
        for pdf in frames:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                if len(text or "") > MCP_BYTES:
                    continue
                try:
                    servers = json.loads(text or "{}").get("mcpServers", {})
                except (ValueError, AttributeError):
                    continue
                for name, s in list(servers.items())[:MCP_SERVERS]:
                    me = f"mcp_{normalize_id(name)}"
                    rows.append((path, normalize_id(path), me, "contains", name))
                    pack = next((a for a in s.get("args", []) if re.match(r"@?[a-z][\w./@-]*$", a)), None)
                    if pack:
                        rows.append((path, me, f"pkg_{normalize_id(pack)}", "uses", pack))
                    rows += [(path, me, f"env_{normalize_id(k)}", "requires_env", k) for k in s.get("env", {})]
            yield pd.DataFrame(rows, columns=["path", "src", "dst", "relation", "label"])

    return files.select("path", "text").mapInPandas(work, FRAGMENT)


def catalog_graph(spark: SparkSession, database: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the tables and columns of a catalog's database."""
    # temporary views are listed with every database and belong to none
    listed = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    tables = [(t, c.name, c.dataType) for t in listed for c in spark.catalog.listColumns(f"`{database}`.`{t}`")]
    df = spark.createDataFrame(tables, "tab string, col string, kind string")
    n = df.select(F.concat(F.lit(f"{database}_"), "tab").alias("id"), F.col("tab").alias("label")).distinct()
    n = n.unionByName(df.select(F.concat_ws("_", F.lit(database), "tab", "col").alias("id"), F.col("col").alias("label")))
    e = df.select(F.concat(F.lit(f"{database}_"), "tab").alias("src"), F.concat_ws("_", F.lit(database), "tab", "col").alias("dst"), F.lit("contains").alias("relation"))
    return n, e


def jdbc_foreign_keys(spark: SparkSession, url: str, properties: dict[str, str]) -> DataFrame:
    """``table, references`` from the information schema of a database that a JDBC driver reaches."""
    q = (
        "(select tc.table_name as \"table\", ccu.table_name as \"references\" from information_schema.table_constraints tc "
        "join information_schema.constraint_column_usage ccu on tc.constraint_name = ccu.constraint_name "
        "where tc.constraint_type = 'FOREIGN KEY') fk"
    )
    return spark.read.jdbc(url, q, properties=properties).distinct()


def symbol_index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions, references) of an index's documents (doc, symbols array<struct<symbol,role>>)."""
    s = documents.select("doc", F.posexplode("symbols").alias("pos", "s")).select("doc", "pos", "s.symbol", "s.role")
    d = s.where("role = 'definition'").select("doc", "symbol", F.concat_ws("#", "doc", "symbol").alias("id")).distinct()
    r = s.where("role <> 'definition'").select(F.concat_ws("@", "doc", "pos").alias("ref"), "doc", "symbol")
    return d, r


def interpreter(first_line: str | None) -> str | None:
    """The program of a shebang line: through ``env``, its flags and assignments, without versions."""
    m = re.match(r"#!\s*(\S+)((?:\s+\S+)*)", first_line or "")
    if not m:
        return None
    prog, args = m[1].rsplit("/", 1)[-1], m[2].split()
    if prog == "env":
        args = [a for a in args if not a.startswith("-") and not re.match(r"\w+=", a)]
        prog = args[0].rsplit("/", 1)[-1] if args else ""
    return re.sub(r"[0-9.]+$", "", prog) or None


def interpreter_column(first_line: Column) -> Column:
    """The same as a column expression."""
    words = F.split(F.trim(F.regexp_extract(first_line, r"^#!\s*(\S.*)", 1)), r"\s+")
    args = F.filter(F.slice(words, 2, 1000), lambda a: ~a.startswith("-") & ~a.rlike(r"^\w+="))
    prog = F.substring_index(F.get(words, F.lit(0)), "/", -1)
    prog = F.when(prog == "env", F.substring_index(F.get(args, F.lit(0)), "/", -1)).otherwise(prog)
    return F.nullif(F.regexp_replace(prog, r"[0-9.]+$", ""), F.lit(""))


def conversations_documents(conversations: DataFrame) -> DataFrame:
    """``doc, text`` of dialogues, turns in order."""
    g = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return g.select(F.col("conv_id").cast("string").alias("doc"), F.array_join(F.transform("t", lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("text"))
