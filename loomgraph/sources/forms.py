"""Extractors of declarative formats: solutions, templates, form files, module manifests, maps and interface files.

Like those of ``extract``: fn(path, text) -> (nodes, edges, raw calls). A text without anything to find gives the file's
node alone; repeated elements give one node and one edge.
"""

from __future__ import annotations

import re
import struct
import zlib

from loomgraph.functions import text as X
from loomgraph.sources.extract import BINARY, _file, register_extractor

# Keys of a module manifest that name modules, and capitalised tags that are HTML rather than components.
MODULE_KEYS = ("RootModule", "NestedModules", "RequiredModules")
HTML_TAGS = (
    "DOCTYPE", "Html", "Head", "Body", "Div", "Span", "Table", "Form", "Input", "Button", "Select", "Option", "Label", "Textarea",
    "Script", "Style", "Link", "Meta", "Title", "Header", "Footer", "Nav", "Main", "Section", "Article", "Aside",
)
# Built-in types below which types of a DM program hang.
ROOT_TYPES = ("area", "atom", "client", "datum", "image", "mob", "obj", "turf", "world")
#: Bytes of a decompressed icon description that are read.
DESCRIPTION_BYTES = 1 << 20


class Parts:
    """Nodes and edges of one file, each once, in the order of their finding."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.root, own = _file(path)
        self.nodes, self.edges, self.calls = {self.root: own}, {}, {}

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def node(self, i: str, label: str, line: int, kind: str = "code") -> str:
        self.nodes.setdefault(i, (i, label, kind, self.path, f"L{line}"))
        return i

    def edge(self, src: str, dst: str, relation: str, context: str | None = None) -> None:
        if dst and src != dst:
            self.edges.setdefault((src, dst, relation), (src, dst, relation, "EXTRACTED", self.path, context))

    def named(self, name: str, relation: str, at: int, prefix: str = "", label: str | None = None) -> str:
        """An element that the file mentions by a name of its own, and the file's edge to it."""
        i = self.node(X.normalize_id(f"{prefix} {name}".strip()), label or name, self.line(at))
        self.edge(self.root, i, relation)
        return i

    def done(self):
        return list(self.nodes.values()), list(self.edges.values()), list(self.calls)


def _module(path: str) -> str:
    """The id of a file that a path names."""
    return X.normalize_id(re.sub(r"\.[^./]+$", "", path.replace("\\", "/").lstrip("./")))


def extract_sln(path: str, text: str):
    """``contains`` the projects; ``imports`` between projects from their dependency sections."""
    p = Parts(path, text)
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    blocks = []
    for m in re.finditer(r'^Project\("[^"]*"\)\s*=\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"\{?([^"}]*)\}?"(.*?)^EndProject\s*$', text, re.M | re.S):
        i = p.node(_module(folder + m[2]), m[1], p.line(m.start()))
        p.edge(p.root, i, "contains")
        needs = "".join(re.findall(r"ProjectSection\(ProjectDependencies\)(.*?)EndProjectSection", m[4], re.S))
        blocks.append((m[3].lower(), i, [g.lower() for g in re.findall(r"\{([0-9a-fA-F-]+)\}\s*=", needs)]))
    project = {guid: i for guid, i, _ in blocks}
    for _, i, needs in blocks:
        for guid in needs:
            p.edge(i, project.get(guid, ""), "imports")
    return p.done()


def extract_blade(path: str, text: str):
    """``includes`` partials, ``uses_component`` components, ``binds_method`` handlers of clicks."""
    p = Parts(path, text)
    for pattern, relation in ((r"@include\(\s*['\"]([^'\"]+)", "includes"), (r"<livewire:([\w.-]+)", "uses_component"), (r"wire:click=[\"']([^\"']+)", "binds_method")):
        for m in re.finditer(pattern, text):
            p.named(m[1], relation, m.start())
    return p.done()


def _closing(text: str, at: int) -> int:
    """The place of the brace that closes the one before ``at``, or the end."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text)


def extract_razor(path: str, text: str):
    """Directives, routes, components that are used, and methods of code blocks."""
    p = Parts(path, text)
    relation = {"using": "imports", "inject": "imports", "inherits": "inherits", "model": "references"}
    for m in re.finditer(r'^@(?:(using|inject|inherits|model)\s+([\w.<>\[\]]+)|page\s+"([^"]+)")', text, re.M):
        if m[1]:
            p.named(m[2], relation[m[1]], m.start())
        else:
            p.edge(p.root, p.node(X.normalize_id(f"route {m[3]}"), f"route:{m[3]}", p.line(m.start()), "concept"), "references")
    for m in re.finditer(r"<([A-Z][A-Za-z0-9]+)[\s/>]", text):
        if m[1] not in HTML_TAGS:
            p.named(m[1], "calls", m.start())
    method = re.compile(r"\b(?:public|private|protected|internal|static|async|override|virtual|abstract)\s+[\w<>\[\], \t]*?(\w+)\s*\(")
    for block in re.finditer(r"@(?:code|functions)\s*\{", text):
        for m in method.finditer(text, block.end(), _closing(text, block.end())):
            p.named(m[1], "contains", m.start(), p.root)
    return p.done()


def extract_form(path: str, text: str):
    """Text forms: ``contains`` along the nesting of components, ``references`` to event handlers. Binary forms are refused."""
    if text[:1] in ("�", "\xff") or text.startswith("TPF0"):
        raise ValueError("binary form")
    p = Parts(path, text)
    above = [p.root]
    for no, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*(?:object|inherited|inline)\s+\w+\s*:\s*(\w+)", line, re.I):
            i = p.node(X.normalize_id(f"{p.root} {m[1]}"), m[1], no)
            p.edge(above[-1], i, "contains")
            above.append(i)
        elif len(above) > 1 and (m := re.match(r"\s*On\w+\s*=\s*(\w+)", line, re.I)):
            p.edge(above[-1], p.node(X.normalize_id(f"{p.root} {m[1]}"), f"{m[1]}()", no), "references", "event")
        elif len(above) > 1 and re.match(r"\s*end\s*>?\s*$", line, re.I):
            above.pop()
    return p.done()


def extract_module_manifest(path: str, text: str):
    """``imports_from`` the modules that a PowerShell manifest names; of a module's specification only its name counts."""
    p = Parts(path, text)
    clean = re.sub(r"<#.*?#>|(?m:^[ \t]*#[^\n]*$)", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    key = re.compile(rf"^\s*({'|'.join(MODULE_KEYS)})\s*=\s*(@\(|@\{{|['\"][^'\"\n]*['\"])", re.M)
    for m in key.finditer(clean):
        value = m[2]
        if value.startswith("@"):
            # the value ends where the bracket that opened it closes
            depth, end = 0, len(clean)
            for b in re.compile(r"[(){}]").finditer(clean, m.start(2)):
                depth += 1 if b[0] in "({" else -1
                if not depth:
                    end = b.end()
                    break
            value = clean[m.start(2):end]
        specs = re.findall(r"@\{([^{}]*)\}", value)
        names = re.findall(r"['\"]([^'\"]+)['\"]", re.sub(r"@\{[^{}]*\}", " ", value))
        names += [n for s in specs for n in re.findall(r"\bModuleName\s*=\s*['\"]([^'\"]+)", s)]
        for n in names:
            p.edge(p.root, X.normalize_id(re.sub(r"\.(psd1|psm1|ps1|dll)$", "", n.replace("\\", "/").split("/")[-1], flags=re.I)), "imports_from", "import")
    return p.done()


def _description(data: bytes) -> str:
    """The text chunk ``Description`` of a PNG, at most 1 MB of it; empty where there is none."""
    at = 8 if data[:8] == b"\x89PNG\r\n\x1a\n" else len(data)
    while at + 8 <= len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        key, _, value = data[at + 8 : at + 8 + size].partition(b"\0")
        if key == b"Description" and kind == b"tEXt":
            return value[:DESCRIPTION_BYTES].decode("utf-8", "replace")
        if key == b"Description" and kind == b"zTXt":
            return zlib.decompressobj().decompress(value[1:], DESCRIPTION_BYTES).decode("utf-8", "replace")
        at += 12 + size
    return ""


def extract_icons(path: str, content: bytes):
    """``contains`` the states of an icon sheet; takes bytes."""
    p = Parts(path, _description(content))
    for m in re.finditer(r'^[ \t]*state[ \t]*=[ \t]*"?(.*?)"?[ \t]*$', p.text, re.M):
        if m[1]:
            p.named(m[1], "contains", m.start(), f"{p.root} state", f'"{m[1]}"')
    return p.done()


def extract_map(path: str, text: str):
    """``uses`` the types that a map's tile dictionary names; the grid behind it is skipped."""
    p = Parts(path, text)
    grid = re.search(r"^\(\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\)\s*=", text, re.M)
    tiles = text[: grid.start()] if grid else text
    # quoted values may hold brackets, commas and slashes: they go first, then the values in braces
    tiles = re.sub(r"\{[^{}]*\}", "", re.sub(r'"(?:[^"\\]|\\.)*"', '""', tiles))
    for m in re.finditer(r"(?<=[(,])\s*(/[\w/]+)", tiles):
        p.edge(p.root, X.normalize_id(m[1]), "uses", "map")
    return p.done()


def extract_interface(path: str, text: str):
    """``contains`` windows, and windows their controls, whose label carries their type."""
    p = Parts(path, text)
    window = control = None
    for no, line in enumerate(text.split("\n"), 1):
        if not (m := re.match(r'\s*(?:(window|elem)\s+"([^"]+)"|type\s*=\s*(\S+))\s*$', line)):
            continue
        if m[1] == "window":
            window, control = p.node(X.normalize_id(f"{p.root} window {m[2]}"), f'window "{m[2]}"', no), None
            p.edge(p.root, window, "contains")
        elif m[1] and window:
            control = p.node(X.normalize_id(f"{window} elem {m[2]}"), f'elem "{m[2]}"', no)
            p.edge(window, control, "contains")
        elif m[3] and control and not p.nodes[control][1].endswith("]"):
            i, label, *rest = p.nodes[control]
            p.nodes[control] = (i, f"{label} [{m[3]}]", *rest)
    return p.done()


def extract_dream(path: str, text: str):
    """Types by their paths, procedures as ``method`` (``contains`` where global), includes, calls and ``instantiates``.

    Nesting is by indentation: a path without arguments opens a type, one with arguments a procedure, whose deeper lines
    are its body.
    """
    p = Parts(path, text)
    clean = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    above: list[tuple[int, list[str]]] = []
    body: tuple[int, str] | None = None
    for no, line in enumerate(clean.split("\n"), 1):
        if m := re.match(r'\s*#include\s+"([^"]+)"', line):
            p.edge(p.root, _module(m[1]), "imports_from", "import")
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
        if body and depth <= body[0]:
            body = None
        if body:
            for made, dot, call in re.findall(r"\bnew\s*(/[\w/]+)|(\.?)\b([A-Za-z_]\w*)\s*\(", re.sub(r'"(?:[^"\\]|\\.)*"', '""', line)):
                if made:
                    p.edge(body[1], X.normalize_id(made), "instantiates", "call")
                elif call not in ("if", "for", "while", "switch", "return", "new", "spawn", "sleep"):
                    p.calls[(body[1], call, bool(dot))] = None
            continue
        while above and above[-1][0] >= depth:
            above.pop()
        m = re.match(r"\s*(/?[A-Za-z_][\w/]*)\s*(\(.*)?$", line)
        if not m:
            continue
        names = [n for n in m[1].split("/") if n]
        nested = above and not m[1].startswith("/")
        full = above[-1][1] + names if nested else names
        if "var" in names or not (m[1].startswith("/") or full[0] in (*ROOT_TYPES, "proc") or nested):
            continue
        owner = [n for n in full if n not in ("proc", "verb")]
        if not m[2]:
            above.append((depth, full))
            if owner and owner == full:
                p.edge(p.root, p.node(X.normalize_id(" ".join(owner)), "/" + "/".join(owner), no), "contains")
            continue
        kind = X.normalize_id(" ".join(owner[:-1]))
        if kind:
            p.edge(p.root, p.node(kind, "/" + "/".join(owner[:-1]), no), "contains")
        i = p.node(X.normalize_id(" ".join([kind or p.root, owner[-1]])), f"{owner[-1]}()", no)
        p.edge(kind or p.root, i, "method" if kind else "contains")
        body = (depth, i)
    return p.done()


for _suffixes, _fn in (
    (("sln",), extract_sln), (("blade.php",), extract_blade), (("razor", "cshtml"), extract_razor), (("lfm", "dfm"), extract_form),
    (("psd1",), extract_module_manifest), (("dmi",), extract_icons), (("dmm",), extract_map), (("dmf",), extract_interface),
    (("dm", "dme"), extract_dream),
):
    for _s in _suffixes:
        register_extractor(_s, _fn)
BINARY.add("dmi")
