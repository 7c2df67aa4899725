"""Sources: corpus scans, extractors of single files, front matter, links, manifests, url and graph JSON readers."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X

NODE = "struct<id:string,label:string,file_type:string,source_file:string,source_location:string>"
EDGE = "struct<src:string,dst:string,relation:string,confidence:string,source_file:string,context:string>"
FRAGMENT = f"path string, nodes array<{NODE}>, edges array<{EDGE}>, raw_calls array<struct<caller:string,callee:string,is_member:boolean>>, error string"
#: Extractors by suffix: fn(path, text) -> (nodes, edges, raw calls) as tuples in the order of the schema.
REGISTRY: dict[str, Callable] = {}
#: Suffixes whose extractors take a file's bytes.
BINARY: set[str] = set()
# Folders that hold no sources, generated files, and what a research paper's first page tends to say.
NOISE_DIRS = (
    "venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out", "site-packages",
    "lib64", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs", "coverage", "lcov-report", "visual-tests",
    "visual-test", "__snapshots__", "storybook-static", "dist-protected", ".next", ".nuxt", ".turbo", ".angular", ".idea",
    ".cache", ".parcel-cache", ".svelte-kit", ".terraform", ".serverless", ".worktrees",
)
NOISE_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock",
    "go.sum", "go.work.sum",
)
PAPER_SIGNALS = (r"\babstract\b", r"\bintroduction\b", r"\breferences\b", r"\bet al\b", r"\bdoi\b", r"\barxiv\b", r"\bfigure [0-9]", r"\btable [0-9]", r"\[[0-9]+\]", r"\bconclusion", r"\bmethod", r"\bexperiment", r"\bdataset\b")
# Folders and names of secrets, words that name a secret where a file name ends in them or is short, and
# data formats in which such a word counts although they are parsed as code.
SECRET_DIRS = (".ssh", ".gnupg", ".aws", ".gcloud", "secrets", ".secrets", "credentials")
SECRET_NAMES = (
    r"(?i)^\.(env|envrc)(\.|$)", r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)(\.netrc|\.pgpass|\.htpasswd)$", r"(?i)(aws_credentials|gcloud_credentials|service.account)",
)
SECRET_WORDS = ("credential", "secret", "passwd", "password", "private_key", "token")
SECRET_DATA = ("json", "yaml", "yml", "toml", "ini", "cfg", "conf", "config", "xml", "properties", "env", "txt")
#: Words in a corpus from which a graph pays, and from which the size deserves a warning.
GRAPH_WORDS, MANY_WORDS, MANY_FILES = 50_000, 500_000, 500


def register_extractor(suffix: str, fn: Callable) -> None:
    REGISTRY[suffix.lower()] = fn


def extractor(path: str, registry: dict[str, Callable]) -> str | None:
    """The suffix under which a file's extractor is registered; one of two parts (``x.blade.php``) goes first."""
    name = path.rsplit("/", 1)[-1].lower().split(".")
    return next((s for s in (".".join(name[-2:]) if len(name) > 2 else "", name[-1]) if s in registry), None)


def scan(spark: SparkSession, root: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """``path, text`` of the files under a folder, noise folders and generated files left out; on request their ``content``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rel = F.regexp_replace("path", r"^(file:|[a-z0-9]+://[^/]*)?/*", "")
    base = re.sub(r"^([a-z]+:)?/*", "", root.rstrip("/")) + "/"
    out = raw.select(F.replace(rel, F.lit(base), F.lit("")).alias("path"), F.decode("content", "UTF-8").alias("text"), *(["content"] if content else []))
    return out.where(~is_noise(F.col("path")))


def _folders(path: Column) -> Column:
    """The folders above a file; its own name isn't one."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def is_noise(path: Column) -> Column:
    return F.exists(_folders(path), lambda p: p.isin(*NOISE_DIRS) | p.endswith(".egg-info")) | X.basename(path).isin(*NOISE_FILES)


def survey(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """``path, text, kind`` of the files (path, text) that a graph is made of: no noise, secrets or ignored paths."""
    kept = files.where(~is_noise(F.col("path")) & ~is_sensitive(F.col("path")))
    if rules:
        kept = kept.join(ignored(kept.select("path"), rules).where("not ignored").select("path").distinct(), "path", "left_semi")
    return kept.select("path", "text", file_kind(F.col("path"), F.col("text")).alias("kind"))


def file_kind(path: Column, text: Column) -> Column:
    """code, paper, image or document; a text is a paper with three signals in its first 3000 characters."""
    kind = X.file_category(path)
    head = F.lower(F.substring(text, 1, 3000))
    signals = sum((head.rlike(p).cast("int") for p in PAPER_SIGNALS), F.lit(0))
    return F.when((kind == "doc") & (signals >= 3), "paper").when(kind == "doc", "document").otherwise(kind)


def is_sensitive(path: Column) -> Column:
    """A secret by a folder above the file, by its name, or by a word that its name is about.

    A word counts at the end of the name's first part, or anywhere in one of at most two words; source code in a
    programming language isn't judged by words.
    """
    name = X.basename(path)
    named = F.lit(False)
    for pattern in SECRET_NAMES:
        named = named | name.rlike(pattern)
    stem = F.substring_index(F.regexp_replace(name, r"^\.+", ""), ".", 1)
    word = rf"(?i)(?<![a-zA-Z0-9])({'|'.join(SECRET_WORDS)})s?"
    parts = F.size(F.filter(F.split(stem, r"[-_\s]+"), lambda w: w != ""))
    about = stem.rlike(word + "$") | (stem.rlike(word + "(?![a-zA-Z])") & (parts <= 2))
    source = (X.file_category(path) == "code") & ~X.extension(path).isin(*(f".{x}" for x in SECRET_DATA), *SECRET_DATA)
    return F.exists(_folders(path), lambda p: p.isin(*SECRET_DIRS)) | named | (about & ~F.coalesce(source, F.lit(False)))


def ignored(paths: DataFrame, rules: list[str]) -> DataFrame:
    """``path, ignored`` under ignore rules: the last match wins, ``!`` takes back, an excluded parent can't be taken back.

    The rules are few; each becomes a pattern, and each path is judged at every folder above it.
    """
    def regex(rule: str) -> str:
        anchored = rule.startswith("/") or "/" in rule.rstrip("/")
        body = re.escape(rule.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        return ("^" if anchored else "^(?:.*/)?") + body + "$"

    parsed = [(r.startswith("!"), regex(r.lstrip("!")), r.endswith("/")) for r in rules if r.strip() and not r.startswith("#")]
    parts = F.split("path", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    out = paths.withColumn("_levels", levels)

    def state(level: Column) -> Column:
        s = F.lit(False)
        for negated, pattern, folder in parsed:
            hit = level.rlike(pattern)
            if folder:
                hit = hit & (level != F.col("path"))
            s = F.when(hit, F.lit(not negated)).otherwise(s)
        return s

    return out.select("path", F.exists("_levels", state).alias("ignored"))


def corpus_stats(files: DataFrame) -> DataFrame:
    """``kind, n_files, n_words`` of (kind, text)."""
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"), F.sum(X.word_count(F.coalesce("text", F.lit("")))).alias("n_words"))


def corpus_verdict(stats: DataFrame) -> DataFrame:
    """One row ``n_files, n_words, needs_graph, warning``."""
    t = stats.agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"))
    warn = F.when(F.col("n_words") > MANY_WORDS, "many words").when(F.col("n_files") > MANY_FILES, "many files").when(F.col("n_words") < GRAPH_WORDS, "small corpus")
    return t.select("*", (F.col("n_words") >= GRAPH_WORDS).alias("needs_graph"), warn.alias("warning"))


# Extractors ---------------------------------------------------------------------------------------


def _file(path: str) -> tuple[str, tuple]:
    stem = X.normalize_id(re.sub(r"\.[^./]+$", "", path))
    kind = "document" if path.rsplit(".", 1)[-1] in ("md", "txt", "html", "json", "rst") else "code"
    return stem, (stem, path.rsplit("/", 1)[-1], kind, path, "L1")


def extract_markdown(path: str, text: str):
    """Headings make a tree of ``contains``, links ``references``; fenced code is skipped."""
    root, node = _file(path)
    nodes, edges, stack, fence = [node], [], [(0, root)], False
    seen = {root}
    for no, line in enumerate(text.split("\n"), 1):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        if fence:
            continue
        if m := re.match(r"(#{1,6})\s+(.+?)\s*#*$", line):
            level = len(m[1])
            base = i = f"{root}_{X.normalize_id(m[2])}"
            while i in seen:
                i = f"{base}_{no}"
            seen.add(i)
            while stack[-1][0] >= level:
                stack.pop()
            nodes.append((i, m[2], "document", path, f"L{no}"))
            edges.append((stack[-1][1], i, "contains", "EXTRACTED", path, None))
            stack.append((level, i))
        for target in re.findall(r"(?<!!)\[[^\]]*\]\(([^)\s#]+)[^)]*\)", line):
            if not re.match(r"[a-z]+:", target):
                to = X.normalize_id(re.sub(r"\.[^./]+$", "", target.lstrip("./")))
                edges.append((stack[-1][1], to, "references", "EXTRACTED", path, "link"))
    return nodes, edges, []


def extract_python(path: str, text: str):
    """Functions, classes and methods; imports, bases, calls; docstrings of more than 20 characters as rationale."""
    root, node = _file(path)
    nodes, edges, calls = [node], [], []
    tree = ast.parse(text)

    def rationale(owner: str, item) -> None:
        doc = ast.get_docstring(item)
        if doc and len(doc) > 20:
            i = f"{owner}_rationale"
            nodes.append((i, doc.split("\n\n")[0][:256], "rationale", path, f"L{getattr(item, 'lineno', 1)}"))
            edges.append((i, owner, "rationale_for", "EXTRACTED", path, None))

    def visit(body, owner: str, in_class: bool) -> None:
        for item in body:
            if isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
                i = f"{owner}_{X.normalize_id(item.name)}"
                nodes.append((i, f".{item.name}()" if in_class else f"{item.name}()", "code", path, f"L{item.lineno}"))
                edges.append((owner, i, "method" if in_class else "contains", "EXTRACTED", path, None))
                rationale(i, item)
                for c in ast.walk(item):
                    if isinstance(c, ast.Call):
                        f = c.func
                        if isinstance(f, ast.Name):
                            calls.append((i, f.id, False))
                        elif isinstance(f, ast.Attribute):
                            calls.append((i, f.attr, True))
            elif isinstance(item, ast.ClassDef):
                i = f"{owner}_{X.normalize_id(item.name)}"
                nodes.append((i, item.name, "code", path, f"L{item.lineno}"))
                edges.append((owner, i, "contains", "EXTRACTED", path, None))
                rationale(i, item)
                for b in item.bases:
                    if isinstance(b, ast.Name):
                        edges.append((i, X.normalize_id(b.id), "inherits", "EXTRACTED", path, None))
                visit(item.body, i, True)
            elif isinstance(item, ast.Import):
                edges.extend((root, X.normalize_id(a.name), "imports", "EXTRACTED", path, "import") for a in item.names)
            elif isinstance(item, ast.ImportFrom) and item.module:
                edges.append((root, X.normalize_id(item.module), "imports_from", "EXTRACTED", path, "import"))

    rationale(root, tree)
    visit(tree.body, root, False)
    return nodes, edges, calls


def extract_sql(path: str, text: str):
    """Tables, views, functions and triggers; foreign keys, what views read, what triggers watch."""
    root, node = _file(path)
    nodes, edges = [node], []
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    clean = lambda n: n.strip('"`[]').split(".")[-1].strip('"`[]')
    for m in re.finditer(r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(table|view|function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)([^;]*)", text, re.I):
        kind, name, body = m[1].lower(), clean(m[2]), m[3]
        i = f"{root}_{X.normalize_id(name)}"
        nodes.append((i, f"{name}()" if kind in ("function", "procedure") else name, "code", path, f"L{text.count(chr(10), 0, m.start()) + 1}"))
        edges.append((root, i, "contains", "EXTRACTED", path, kind))
        to = lambda t: f"{root}_{X.normalize_id(clean(t))}"
        if kind == "table":
            edges += [(i, to(t), "references", "EXTRACTED", path, "foreign_key") for t in re.findall(r"\breferences\s+([\w.\"`\[\]]+)", body, re.I)]
        elif kind == "trigger":
            edges += [(to(t), i, "triggers", "EXTRACTED", path, None) for t in re.findall(r"\bon\s+([\w.\"`\[\]]+)", body, re.I)[:1]]
        else:
            edges += [(i, to(t), "reads_from", "EXTRACTED", path, None) for t in dict.fromkeys(re.findall(r"\b(?:from|join)\s+([\w.\"`\[\]]+)", body, re.I))]
    return nodes, edges, []


def extract_json(path: str, text: str):
    """Top-level keys, dependencies and ``extends`` of a configuration."""
    root, node = _file(path)
    nodes, edges = [node], []
    data = json.loads(text)
    for k, v in data.items() if isinstance(data, dict) else ():
        i = f"{root}_{X.normalize_id(k)}"
        nodes.append((i, k, "document", path, None))
        edges.append((root, i, "contains", "EXTRACTED", path, None))
        if k in ("dependencies", "devDependencies", "peerDependencies") and isinstance(v, dict):
            edges += [(root, f"pkg_{X.normalize_id(d)}", "depends_on", "EXTRACTED", path, k) for d in v]
        if k == "extends":
            edges += [(root, X.normalize_id(re.sub(r"\.[^./]+$", "", str(d))), "extends", "EXTRACTED", path, None) for d in (v if isinstance(v, list) else [v])]
    return nodes, edges, []


def extract_xml(path: str, text: str):
    """Project files: references to projects and packages."""
    root, node = _file(path)
    edges = []
    for tag, to in re.findall(r"<(ProjectReference|PackageReference|Reference|Project)\b[^>]*\b(?:Include|Path)=\"([^\"]+)\"", text):
        name = X.normalize_id(re.sub(r"\.\w+proj$", "", to.replace("\\", "/").split("/")[-1]))
        edges.append((root, name if "Project" in tag else f"pkg_{name}", "imports" if "Project" in tag else "references", "EXTRACTED", path, tag))
    return [node], edges, []


def _patterned(defs: list[tuple[str, str, str]], uses: list[tuple[str, str]], line_comment: str) -> Callable:
    """An extractor from (pattern, label format, relation) definitions and (pattern, relation) uses."""
    def extract(path: str, text: str):
        root, node = _file(path)
        nodes, edges, seen = [node], [], {root}
        clean = re.sub(line_comment + r"[^\n]*", "", text) if line_comment else text
        for pattern, fmt, relation in defs:
            for m in re.finditer(pattern, clean, re.M):
                i = f"{root}_{X.normalize_id(m[1])}"
                if i not in seen:
                    seen.add(i)
                    nodes.append((i, fmt.format(m[1]), "code", path, f"L{clean.count(chr(10), 0, m.start()) + 1}"))
                    edges.append((root, i, relation, "EXTRACTED", path, None))
        for pattern, relation in uses:
            for t in dict.fromkeys(re.findall(pattern, clean, re.M)):
                edges.append((root, X.normalize_id(re.sub(r"\.[^./]+$", "", t)), relation, "EXTRACTED", path, "import"))
        calls = [(root, c, False) for c in dict.fromkeys(re.findall(r"\b([A-Za-z_]\w*)\s*\(", clean))] if defs else []
        return nodes, edges, calls
    return extract


_CLASS = (r"^\s*(?:public |private |protected |internal |abstract |final |sealed |static |export |default |open |data )*(?:class|interface|trait|struct|enum|object|protocol)\s+([A-Za-z_]\w*)", "{}", "contains")
_C_FUNC = (r"^[A-Za-z_][\w\s\*&<>:,]*?\b([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?\{", "{}()", "contains")
for _suffixes, _defs, _uses, _comment in (
    (("js", "jsx", "ts", "tsx", "mjs", "vue", "svelte", "astro"), [_CLASS, (r"\bfunction\s+([A-Za-z_$]\w*)", "{}()", "contains"), (r"^\s*(?:export\s+)?const\s+([A-Za-z_$]\w*)\s*=\s*(?:async\s*)?\(", "{}()", "contains")], [(r"\bfrom\s+['\"]([^'\"]+)['\"]", "imports_from"), (r"\bimport\(['\"]([^'\"]+)['\"]\)", "dynamic_import"), (r"\brequire\(['\"]([^'\"]+)['\"]\)", "imports")], "//"),
    (("java", "kt", "scala", "groovy", "cs"), [_CLASS, (r"^\s*(?:[\w<>\[\],@]+\s+)+([a-zA-Z_]\w*)\s*\([^;{}]*\)\s*(?:throws [\w, ]+)?\{", ".{}()", "method"), (r"\bfun\s+([A-Za-z_]\w*)", "{}()", "contains"), (r"\bdef\s+([A-Za-z_]\w*)", "{}()", "contains")], [(r"^\s*import\s+(?:static\s+)?([\w.]+)", "imports"), (r"^\s*using\s+([\w.]+)\s*;", "imports")], "//"),
    (("c", "h", "cc", "cpp", "hpp", "m", "mm", "v", "sv"), [_CLASS, _C_FUNC, (r"^\s*module\s+([A-Za-z_]\w*)", "{}", "contains")], [(r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]", "imports"), (r"^\s*#?import\s+[<\"]([^>\"]+)[>\"]", "imports")], "//"),
    (("go",), [(r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", "{}()", "contains"), (r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)", "{}", "contains")], [(r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"$", "imports")], "//"),
    (("rs", "zig"), [(r"\bfn\s+([A-Za-z_]\w*)", "{}()", "contains"), (r"\b(?:struct|enum|trait)\s+([A-Za-z_]\w*)", "{}", "contains")], [(r"^\s*(?:pub\s+)?use\s+([\w:]+)", "imports"), (r"@import\(\"([^\"]+)\"\)", "imports_from")], "//"),
    (("rb", "ex", "exs", "jl", "cr"), [(r"^\s*(?:class|module|defmodule|struct)\s+([A-Z][\w.:]*)", "{}", "contains"), (r"^\s*(?:def|defp|function)\s+(?:self\.)?([a-z_]\w*[?!]?)", "{}()", "method")], [(r"^\s*(?:require|require_relative|alias|import|using|use)\s+['\"]?([\w./:]+)", "imports")], "#"),
    (("php", "swift", "dart"), [_CLASS, (r"\b(?:function|func)\s+([A-Za-z_]\w*)", "{}()", "contains")], [(r"^\s*(?:use|import)\s+['\"]?([\w\\./:]+)", "imports")], "//"),
    (("lua",), [(r"\bfunction\s+([\w.:]+)", "{}()", "contains")], [(r"\brequire\s*\(?['\"]([^'\"]+)['\"]", "imports")], "--"),
    (("sh", "bash", "ps1", "psm1"), [(r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{", "{}()", "defines"), (r"^\s*function\s+([A-Za-z_][\w-]*)", "{}()", "defines")], [(r"^\s*(?:source|\.)\s+([\w./-]+)", "imports_from"), (r"^\s*Import-Module\s+([\w./-]+)", "imports")], "#"),
    (("tf", "hcl"), [(r"^\s*(?:resource|data)\s+\"[^\"]+\"\s+\"([^\"]+)\"", "{}", "contains"), (r"^\s*(?:variable|module|output|provider)\s+\"([^\"]+)\"", "{}", "contains")], [(r"\bsource\s*=\s*\"([^\"]+)\"", "references")], "#"),
    (("pas", "pp", "f90", "f", "for"), [(r"(?i)^\s*(?:procedure|function|subroutine|program|unit)\s+([A-Za-z_]\w*)", "{}()", "contains"), (r"(?i)^\s*([A-Za-z_]\w*)\s*=\s*class\b", "{}", "contains")], [(r"(?i)^\s*use\s+([A-Za-z_]\w*)", "imports"), (r"(?i)\buses\s+([A-Za-z_]\w*)", "imports")], ""),
    (("cls", "trigger"), [_CLASS, (r"\btrigger\s+([A-Za-z_]\w*)", "{}", "contains")], [], "//"),
):
    for _s in _suffixes:
        register_extractor(_s, _patterned(_defs, _uses, _comment))
for _s, _fn in (("md", extract_markdown), ("markdown", extract_markdown), ("py", extract_python), ("sql", extract_sql), ("json", extract_json), ("csproj", extract_xml), ("slnx", extract_xml), ("lpk", extract_xml), ("xaml", extract_xml)):
    register_extractor(_s, _fn)


def extract(files: DataFrame) -> DataFrame:
    """A fragment for each (path, text) whose suffix has an extractor; a failure is reported in ``error``.

    Extractors of binary files need a column ``content`` beside the text.
    """
    registry, binary = dict(REGISTRY), set(BINARY)
    columns = ["path", "text"] + (["content"] if "content" in files.columns else [])
    fields = [["id", "label", "file_type", "source_file", "source_location"], ["src", "dst", "relation", "confidence", "source_file", "context"], ["caller", "callee", "is_member"]]

    def work(frames):
        for pdf in frames:
            rows = []
            for path, text, *content in zip(*(pdf[c] for c in columns)):
                suffix = extractor(path, registry)
                if suffix is None:
                    continue
                try:
                    if suffix in binary:
                        if not content or content[0] is None:
                            raise ValueError("no content")
                        text = content[0]
                    parts, error = registry[suffix](path, text or ""), None
                except Exception as e:  # a file that can't be parsed is a result, not a failure of the job
                    parts, error = ([], [], []), f"{type(e).__name__}: {e}"
                rows.append((path, *([dict(zip(names, r)) for r in part] for names, part in zip(fields, parts)), error))
            yield pd.DataFrame(rows, columns=["path", "nodes", "edges", "raw_calls", "error"])

    return files.select(*columns).mapInPandas(work, FRAGMENT)


def exploded(fragments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, raw calls) of fragments."""
    n = fragments.select(F.explode("nodes").alias("n")).select("n.*")
    e = fragments.select(F.explode("edges").alias("e")).select("e.*")
    c = fragments.select("path", F.explode("raw_calls").alias("c")).select("c.*", F.col("path").alias("source_file"))
    return n, e, c


def resolved_calls(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges of direct calls whose name has exactly one callable; with an import between the files EXTRACTED, else INFERRED.

    Of several callables the only one in the caller's file wins, then the only one in an imported file; what stays
    ambiguous resolves to nothing, and pairs that have an edge already are skipped.
    """
    index = nodes.where(F.col("label").endswith("()")).select(X.callable_key(F.col("label")).alias("k"), F.col("id").alias("dst"), F.col("source_file").alias("df"))
    owner = nodes.groupBy("source_file").agg(F.min("id").alias("file_id")).select(F.col("source_file").alias("sf"), "file_id")
    imports = edges.where(F.col("relation").isin("imports", "imports_from")).select(F.col("source_file").alias("sf"), F.col("dst").alias("mod")).distinct()
    stem = X.ascii_id(F.regexp_replace("df", r"\.[^./]+$", ""))
    base = X.ascii_id(F.regexp_replace(X.basename(F.col("df")), r"\.[^.]+$", ""))
    c = calls.where("not is_member").select("caller", F.lower("callee").alias("k"), F.col("source_file").alias("sf")).distinct()
    j = c.join(index, "k").where("caller <> dst").withColumns({"stem": stem, "base": base})
    ev = imports.withColumn("evidence", F.lit(True))
    j = j.join(ev, (j["sf"] == ev["sf"]) & ((j["stem"] == ev["mod"]) | (j["base"] == ev["mod"])), "left").drop(ev["sf"]).drop("mod")
    tier = F.when(F.col("df") == F.col("sf"), 0).when(F.col("evidence"), 1).otherwise(2)
    g = j.select("caller", "k", "dst", tier.alias("tier")).distinct().groupBy("caller", "k", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"))
    best = g.groupBy("caller", "k").agg(F.min(F.struct("tier", "n", "dst")).alias("m")).where("m.n = 1")
    out = best.select(F.col("caller").alias("src"), "m.dst", F.lit("calls").alias("relation"), F.when(F.col("m.tier") < 2, "EXTRACTED").otherwise("INFERRED").alias("confidence")).distinct()
    return out.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


# Readers ------------------------------------------------------------------------------------------

GRAPH_JSON = (
    "directed boolean, multigraph boolean, nodes array<struct<id:string,label:string,file_type:string,source_file:string,source:string,community:int>>,"
    "links array<struct<source:string,target:string,`from`:string,`to`:string,relation:string,confidence:string,confidence_score:double,context:string>>,"
    "edges array<struct<source:string,target:string,`from`:string,`to`:string,relation:string,confidence:string,confidence_score:double,context:string>>,"
    "hyperedges array<struct<id:string,label:string,nodes:array<string>,members:array<string>>>"
)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, hyperedges) of node-link JSON; older spellings of fields are folded in."""
    raw = spark.read.schema(GRAPH_JSON).option("multiLine", "true").json(path)
    n = raw.select(F.explode("nodes").alias("n")).select("n.id", "n.label", "n.file_type", F.coalesce("n.source_file", "n.source").alias("source_file"), "n.community")
    e = raw.select(F.explode(F.coalesce("links", "edges")).alias("e"))
    e = e.select(F.coalesce("e.source", "e.from").alias("src"), F.coalesce("e.target", "e.to").alias("dst"), "e.relation", F.coalesce("e.confidence", F.lit("EXTRACTED")).alias("confidence"), "e.confidence_score", "e.context")
    h = raw.select(F.explode("hyperedges").alias("h")).select("h.id", "h.label", F.coalesce("h.nodes", "h.members").alias("nodes"))
    return n, e, h


def front_matter(docs: DataFrame) -> DataFrame:
    """``doc`` with ``type, date, question, outcome, correction, source_nodes`` of a text's front matter."""
    def field(name: str) -> Column:
        v = F.regexp_extract("text", rf"(?s)\A---\n(?:.*?\n)?{name}:[ \t]*\"?([^\n\"]*)\"?\n", 1)
        return F.when(v != "", v).alias(name)

    nodes = F.regexp_extract("text", r"(?s)\A---\n.*?source_nodes:[ \t]*\[([^\]]*)\]", 1)
    items = F.filter(F.transform(F.split(nodes, ","), lambda x: F.trim(F.regexp_replace(x, '["\']', ""))), lambda x: x != "")
    return docs.select("doc", *map(field, ("type", "date", "question", "outcome", "correction")), items.alias("source_nodes"))


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, href`` of distinct links in HTML."""
    links = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"#]+)"'), F.lit(1))
    return pages.select("page_id", F.explode(F.array_distinct(links)).alias("href"))


def foreign_key_graph(tables: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a schema: tables (name) and keys (table, references)."""
    n = tables.select(X.ascii_id(F.col("name")).alias("id"), F.col("name").alias("label"), F.lit("code").alias("file_type"), F.lit("schema.sql").alias("source_file"))
    e = keys.select(X.ascii_id(F.col("table")).alias("src"), X.ascii_id(F.col("references")).alias("dst"), F.lit("references").alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    return n, e.distinct()


def slices(docs: DataFrame, max_chars: int = 4000) -> DataFrame:
    """``path, part, start, end`` of texts cut at a heading, else a blank line, else a newline, within ``max_chars``."""
    def work(frames):
        for pdf in frames:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                text, at, part = text or "", 0, 0
                while at < len(text):
                    end = min(len(text), at + max_chars)
                    if end < len(text):
                        window = text[at:end]
                        for mark in ("\n#", "\n\n", "\n"):
                            cut = window.rfind(mark)
                            if cut > 0:
                                end = at + cut + 1
                                break
                    rows.append((path, part, at, end))
                    at, part = end, part + 1
            yield pd.DataFrame(rows, columns=["path", "part", "start", "end"])

    return docs.select("path", "text").mapInPandas(work, "path string, part int, start int, end int")


def salvaged_json(text: str) -> dict | None:
    """The first JSON object in prose, fences or not; else pairs of ``"id": "name"``."""
    body = re.sub(r"^```(?:json)?|```$", "", text.strip(), flags=re.M)
    for m in re.finditer(r"\{", body):
        try:
            return json.JSONDecoder().raw_decode(body[m.start():])[0]
        except ValueError:
            continue
    return dict(re.findall(r'"([^"]+)"\s*:\s*"([^"]+)"', body)) or None


from loomgraph.sources import forms  # noqa: E402, F401  (its extractors register themselves)
