"""Fetch rules, drawings, pushes, backups, office files and reloads."""

import io
import json
import time
import zipfile

from pyspark.sql import functions as F

from loomgraph.functions import safety
from loomgraph.sinks import drawing, export, push
from loomgraph.sources import office
from loomgraph.streaming import changes


URLS = [
    ("https://example.org/a", None), ("http://8.8.8.8", None), ("http://172.32.0.1/", None), ("http://192.0.3.1", None), ("http://[2606:4700::1]/", None),
    ("file:///etc/passwd", "scheme"), ("data:text/plain,x", "scheme"), ("", "scheme"), (None, "scheme"), ("example.org", "scheme"),
    ("http://METADATA.google.internal./x", "host"), ("http://a.localhost:8080", "host"), ("http://u:p@127.0.0.1:80/x", "address"),
    ("http://10.1.2.3", "address"), ("http://169.254.169.254/latest", "address"), ("http://100.64.0.1", "address"), ("http://255.255.255.255", "address"),
    ("http://[::1]:80/", "address"), ("http://[fd00::1]", "address"), ("http://[fe80::1]", "address"), ("http://[::ffff:8.8.8.8]", "address"),
    ("http://[64:ff9b::8.8.8.8]", None), ("http://[64:ff9b::10.0.0.1]", "address"),
    ("http://2130706433", "address"), ("http://127.1", "address"), ("http://0x7f.1", "address"), ("http://0177.0.0.1", "address"), ("http://1.2.3.4.example.org", None),
]


def test_urls(spark):
    df = spark.createDataFrame(URLS, "url string, want string")
    assert df.select("url", safety.url_refusal(F.col("url")).alias("got"), "want").where("not got <=> want").collect() == []


PATHS = [("a", True), ("a/../..", False), ("../out/x", True), ("..", False), ("/out", True), ("/outer", False), ("/out/./b//c", True), ("/out/../etc", False), ("", True), (None, None)]


def test_paths(spark):
    df = spark.createDataFrame(PATHS, "path string, want boolean")
    assert df.select("path", safety.inside(F.col("path"), "/out/").alias("got"), "want").where("not got <=> want").collect() == []


def test_canvas(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"l{9 - i}", "code", "f.py", i % 2) for i in range(9)], "id string, label string, file_type string, source_file string, community int")
    boxes = {r["community"]: (r["x"], r["y"], r["width"], r["height"]) for r in drawing.canvas_boxes(nodes).collect()}
    assert boxes == {0: (0, 0, 660, 400), 1: (740, 0, 600, 400)}
    at = {r["id"]: (r["x"], r["y"]) for r in drawing.canvas_cards(nodes).collect()}
    # community 0 by label: n8 n6 n4 / n2 n0
    assert at["n8"] == (20, 80) and at["n4"] == (420, 80) and at["n2"] == (20, 160) and at["n7"] == (760, 80) and len(set(at.values())) == 9
    edges = spark.createDataFrame([("n0", "n1", "calls", "EXTRACTED"), ("n1", "n2", None, None)], "src string, dst string, relation string, confidence string")
    assert {tuple(r) for r in drawing.canvas_edges(edges).collect()} == {("n0", "n1", "calls [EXTRACTED]"), ("n1", "n2", "[EXTRACTED]")}
    lines = [r[0] for r in drawing.svg(nodes, edges).collect()]
    assert len(lines) == 11 and sum(x.startswith("<line") for x in lines) == 2
    assert drawing.canvas_cards(nodes.limit(0)).count() == 0


def connector(folder):
    """A connection that writes what it is told to files of its own; made in here, it travels to workers by value."""
    def connect():
        class Session:
            def run(self, statement, rows):
                import uuid

                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    json.dump([statement, rows], f)

            def close(self):
                pass

        return Session()

    return connect


def test_push(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", "a'b", "co`de", 1, None, [1]) for i in range(5)] + [("m", None, None, 2, 0.5, None)], "id string, label string, file_type string, community int, _x double, tags array<int>")
    edges = spark.createDataFrame([("n0", "n1", "imports from", 2.0)], "src string, dst string, relation string, weight double")
    folder = str(tmp_path)
    push.push(nodes.coalesce(1), edges.coalesce(1), connector(folder), batch=2)
    sent = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    rows = [r for s, rs in sent for r in rs if "(n:" in s]
    assert len(rows) == 6 and max(len(rs) for _, rs in sent) == 2
    assert {"id": "m", "props": {"community": 2}} in rows and {"id": "n0", "props": {"label": "a'b", "file_type": "co`de", "community": 1}} in rows
    assert any("MERGE (n:Code {" in s for s, _ in sent) and any("MERGE (n:Entity {" in s for s, _ in sent)
    (edge,) = [(s, rs) for s, rs in sent if "MATCH" in s]
    assert "[e:IMPORTS_FROM]" in edge[0] and edge[1] == [{"src": "n0", "dst": "n1", "props": {"relation": "imports from", "weight": 2.0}}]


def test_backup(spark, tmp_path):
    path = str(tmp_path / "g")
    assert export.backup_graph(spark, path, "d1") is None
    nodes = spark.createDataFrame([("a", "A", 1, "Community 1")], "id string, label string, community int, community_name string")
    edges = spark.createDataFrame([("a", "a", "calls", "EXTRACTED")], "src string, dst string, relation string, confidence string")
    export.write_graph(nodes, edges, path, backup="d0")
    assert export.backup_graph(spark, path, "d1") is None
    named = nodes.withColumn("community_name", F.lit("Parsers"))
    export.write_graph(named, edges, path, backup="d1")
    assert not (tmp_path / "g/backup").exists()
    export.write_graph(nodes, edges, path, backup="d2")
    assert [r["community_name"] for r in spark.read.json(f"{path}/backup/d2/nodes").collect()] == ["Parsers"]
    assert spark.read.json(f"{path}/backup/d2/edges").count() == 1 and spark.read.json(f"{path}/nodes").first()["community_name"] == "Community 1"
    assert export.backup_graph(spark, path, "d3", always=True) and (tmp_path / "g/backup/d3/nodes").exists()


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


def test_office(spark):
    w = 'xmlns:w="w"'
    doc = zipped(word__document=f'<w:d {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:d>')
    sheet = zipped(xl__sharedStrings="<sst><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>", xl__worksheets__sheet1='<w><sheetData><row><c t="s"><v>1</v></c><c><v>3.5</v></c></row><row><c/></row></sheetData></w>')
    slides = zipped(ppt__slides__slide10="<s><p><r><t>last</t></r></p></s>", ppt__slides__slide2="<s><p><r><t>first</t></r></p><p/></s>")
    bomb, entities = zipped(word__document="<a>" + " " * 3_000_000 + "</a>"), zipped(word__document='<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')
    files = [("a.docx", doc), ("b.XLSX", sheet), ("c.pptx", slides), ("d.docx", bomb), ("e.docx", entities), ("f.docx", b"no zip"), ("g.docx", None), ("h.txt", b"x"), ("i.docx", zipped(other="<a/>")), (None, b"x")]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in files], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"] and r["error"].split(":")[0]) for r in office.office_text(df).collect()}
    assert got == {
        "a.docx": ("## Top\na b\n| x |  |", None), "b.XLSX": ("## Sheet 1\n| two | 3.5 |", None), "c.pptx": ("## Slide 2\nfirst\n## Slide 10\nlast", None),
        "d.docx": (None, "ValueError"), "e.docx": (None, "ValueError"), "f.docx": (None, "BadZipFile"), "g.docx": (None, "TypeError"), "i.docx": ("", None),
    }


def test_reload(spark, tmp_path):
    path, reads = str(tmp_path / "t"), []

    def read(p):
        reads.append(p)
        return spark.read.parquet(p)

    spark.range(3).write.parquet(path)
    t = changes.Reloaded(spark, path, read)
    assert t.get().count() == 3 and t.get().count() == 3 and len(reads) == 1
    time.sleep(0.01)
    spark.range(5).write.mode("overwrite").parquet(path)
    assert t.get().count() == 5 and len(reads) == 2
