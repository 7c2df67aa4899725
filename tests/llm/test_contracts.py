"""Each opN query against a brute-force twin on whole small tables, and on awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, embeddings, fingerprints, licenses, minhash, mixing, pii, quality, substrings, urlfilter, words
from loomgraph.llm import queries as q

TINY = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def rows_of(name, base=TINY):
    return pq.read_table(f"{base}/{name}.parquet").to_pylist()


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


LONG = "abc " * 30000 + "x" * 70000 + "1" * 5000
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", None, 3),
    (4, "One", "en", "b", 3),
    (5, "one two three four", None, "b", 18),
    (6, "ONE two three FOUR", "en", "b", 18),
    (7, LONG, "en", "c", len(LONG)),
    (8, "don't  stop\u00a0now \u2003 x\u001fy ½ ² 一二 ١٢ <|endoftext|> é́  ", "fr", "c", 40),
    (9, "call me +1 (469) 555-8958 or 4111 1111 1111 1111 at 10.0.0.256 or 10.0.0.25.3 a@b@c.de x.y+z@w-1.co.uk.", "en", "c", 9),
    (10, "IBAN GB82 WEST 1234 5698 7654 32 tel 030 1234 5678", "en", "c", 9),
    (11, "one two three four five six seven " * 12, "en", "d", 9),
    (12, "one two three four five six seven " * 12, "en", "d", 9),
    (None, "no id here", "en", "d", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep long, node long, h string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 5, 6, "x") for r in ODD + ODD[4:5]], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


# 1 ------------------------------------------------------------------------------------------------


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    out = []
    for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False):
        decoded = t.decode(e.ids, skip_special_tokens=False)
        out.append((len(e.ids), sha(np.array(e.ids, "<u4").tobytes()), sha(decoded)))
    return out


def test_bpe_is_the_library(spark, odd, none):
    docs = rows_of("documents")
    want = dict(zip((d["doc_id"] for d in docs), library([d["text"] for d in docs])))
    mine = got(q.op1_bpe_round_trip(spark, TINY))
    assert {k: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for k, r in mine.items()} == want
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine = bpe.bpe_round_trip(odd, path).collect()
    assert len(mine) == len(ODD) + 1
    want = {r[0]: w for r, w in zip(ODD, library([r[1] for r in ODD]))}
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want[r["doc_id"]] for r in mine)
    assert bpe.bpe_round_trip(none, path).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(odd, path), path).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)


def test_bpe_splits_every_character_as_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1 {c}{c} b {c}" for c in chars[:0x3200]] + [f"a{c} {c}" for c in chars[0x3200::37]]
    wrong = [x for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)) if e.ids != mine.encode(x)]
    assert not wrong, [x.encode("unicode_escape") for x in wrong[:20]]


# 2 ------------------------------------------------------------------------------------------------


def test_quality_ranks_held_out_documents(spark, odd, none):
    base = "/root/testdata/sf0.01"
    mine = got(q.op2_quality_classifier(spark, base))
    labels = {r["doc_id"]: r["quality"] for r in rows_of("labels", base)}
    import zlib

    assert len(mine) == len(rows_of("documents", base))
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in mine.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in mine.values())
    held = [(mine[k]["score"], y) for k, y in labels.items() if mine[k]["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.9
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, None)], "doc_id long, quality int")
    assert quality.quality_scores(odd, labels).count() == len(ODD) + 1
    assert quality.quality_scores(odd, labels.where("1 = 0")).where("score = 0.5").count() == len(ODD) + 1
    assert quality.quality_scores(none, labels).count() == 0


def test_rejection_is_by_row(spark):
    """Rows of one id, or without one, are judged by their own texts; columns may have any names."""
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scores = docs.join(quality.quality_scores(docs, labels), "doc_id").select("text", "predicted").collect()
    good = {r["text"] for r in scores if r["predicted"]}
    other = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, None).otherwise(F.lit(10**9)))  # ids without labels
    both = docs.unionByName(other).withColumn("_bad_id", F.lit(7))
    left = quality.good_documents(both, labels)
    assert left.columns == both.columns
    rows, texts = left.collect(), [r["text"] for r in scores]
    assert 0 < len(good) < len(set(texts)) and {r["_bad_id"] for r in rows} == {7}
    assert Counter(r["text"] for r in rows) == Counter(t for t in texts + texts if t in good)
    assert quality.good_documents(both.where("1 = 0"), labels).count() == 0


def test_isotonic_is_monotone():
    y = quality.isotonic(np.arange(4), np.array([0.0, 1.0, 0.5, 1.0]), np.array([1.0, 1.0, 3.0, 1.0]))
    assert y.tolist() == [0.0, 0.625, 0.625, 1.0]


# 3 ------------------------------------------------------------------------------------------------


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_vectors_link_as_brute_force(spark):
    rows = rows_of("embeddings", "/root/testdata/sf0.01")
    rows.sort(key=lambda r: r["vec_id"])
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = np.triu(x @ x.T >= 0.9, 1)
    links = list(zip(*np.nonzero(near)))
    n = Counter(i for p in links for i in p)
    comp = components(len(rows), links)
    mine = got(q.op3_embedding_near_dedup(spark, "/root/testdata/sf0.01"), "vec_id")
    for i, r in enumerate(rows):
        m = mine[r["vec_id"]]
        assert (m["n_links"], m["component_id"]) == (n[i], rows[comp[i]]["vec_id"])
        assert m["kept"] == (m["component_id"] == m["vec_id"])


def planted(dim, groups, seed=5):
    """Pairs and clusters of cosines from 0.9 to 0.95, and bystanders: (ids, vectors)."""
    rng = np.random.default_rng(seed)
    out = []
    for cos in np.linspace(0.9001, 0.95, groups):
        a = rng.normal(size=dim)
        a /= np.linalg.norm(a)
        b = rng.normal(size=dim)
        b -= (a @ b) * a
        out += [a, cos * a + np.sqrt(1 - cos * cos) * b / np.linalg.norm(b)]
    out += list(rng.normal(size=(200, dim)))
    return np.array(out) * rng.uniform(0.1, 10, (len(out), 1))


def plain_vectors(ids, x):
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    comp = components(len(ids), list(zip(*np.nonzero(np.triu(near)))))
    low = {}
    for i, c in enumerate(comp):
        low[c] = min(low.get(c, ids[i]), ids[i])
    return sorted((ids[i], int(near[i].sum()), low[comp[i]]) for i in range(len(ids)))


@pytest.mark.parametrize("dim", [48, 256])
def test_planted_pairs_are_found(spark, dim):
    x = planted(dim, 600)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    mine = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect())
    want = plain_vectors(list(range(len(x))), x)
    found, links = sum(r[1] for r in mine), sum(r[1] for r in want)
    assert links >= 1200 and found >= 0.99 * links
    assert all(a[1] <= b[1] for a, b in zip(mine, want))


def test_dense_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "STRIP", 5)
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.02 * rng.normal(size=(90, 32)) for c in rng.normal(size=(2, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    mine = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect())
    assert mine == plain_vectors(list(range(len(x))), x) and mine[0][1] == 89


def test_rows_of_one_vec_id_count_apart(spark):
    v = [(7, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (8, [1.0, 0.01, 0.0]), (9, [0.0, 1.0, 0.01]), (10, [0.01, 1.0, 0.0]), (11, [0.0, 0.0, 1.0])]
    out = embeddings.near_vectors(spark.createDataFrame(v, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out) == [
        (7, 1, 7, True), (7, 2, 7, True), (8, 1, 7, False), (9, 2, 7, False), (10, 2, 7, False), (11, 0, 11, True),
    ]


def test_odd_vectors(spark):
    v = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]),
        (7, []), (8, [0.0, 1.0]), (9, [1.0, None]), (10, [1e30, 1e28]), (6, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]),
        (12, [-0.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in v], "vec_id long, embedding array<float>, n int, bucket string")
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect())
    assert out == [
        (1, 4, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 4, 1), (6, 4, 1), (7, 0, 7), (8, 1, 8), (9, 0, 9),
        (10, 4, 1), (11, 0, 11), (12, 1, 8),
    ]
    assert embeddings.near_vectors(df.where("1 = 0")).count() == 0


# 4 ------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(d) <= 19
                and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0,
                "phone": lambda: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(out)


def test_pii_has_the_plain_spans(spark, odd, none):
    pairs = [(d["doc_id"], d["text"]) for d in rows_of("documents")]
    mine = got(q.op4_pii(spark, TINY))
    odd_rows = {r["doc_id"]: r for r in pii.pii_spans(odd).collect()}
    for source, cases in ((mine, pairs), (odd_rows, [(r[0], (r[1] or "")[:100_000]) for r in ODD if r[0] != 7])):
        for k, text in cases:
            want = plain_pii(text)
            r = source[k]
            assert r["base_sha256"] == sha(",".join(x[2] for x in want))
            assert [r[f"n_{kind}"] for kind in PATTERNS] == [sum(x[3] == kind for x in want) for kind in PATTERNS]
            assert {x[2] for x in want} <= set(filter(None, r["spans"].split(",")))
    assert "iban:5:" in odd_rows[10]["spans"] and "national_phone" in odd_rows[10]["spans"]
    assert pii.pii_spans(none).count() == 0
    masked = got(pii.mask_pii(odd))
    assert masked[9]["text"].startswith("call me <phone> or <card> at 10.0.0.256")
    assert masked[1]["text"] is None and masked[7]["text"] == LONG


@pytest.mark.parametrize("text", ["a@b.c@d.e f@g", "@@a@b.c", "1.2.3.4.5.6.7.8", "1.2.3.", "+1+2345678 90", "a@b..c", "x@-.-@y.z", "12 3456-7890 12-", "é@a.b ü.x@y.z"])
def test_pii_edges(text):
    base = [f"{k}:{s}:{e}" for k, s, e, _ in pii.find_pii(text) if k in PATTERNS]
    assert base == [x[2] for x in plain_pii(text)]


def test_ibans_next_to_each_other():
    one, two = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    spans = lambda t: [t[s:e] for k, s, e, _ in pii.find_pii(t) if k == "iban"]
    assert spans(f"{one} {two}") == [one, two]
    assert spans("AB12 DE89370400440532013000") == ["DE89370400440532013000"]
    assert spans("DE89 3704 0044 0532 0130 01 " + two) == [two]
    assert pii.mask(f"pay {one} {two} now") == "pay <iban> <iban> now"


def test_words_nearby_move_the_score():
    card = "4111 1111 1111 1111"
    base = pii.BASE_SCORE["card"]
    for before, moved in (("", 0), ("visa ", pii.BONUS), ("order ", -pii.BONUS), ("order visa ", 0), ("visa " + "x" * pii.REACH + " ", 0)):
        (span,) = pii.find_pii(before + card)
        assert span[0] == "card" and span[3] == pytest.approx(min(1, base + moved))
    number = "030 1234 5678"
    assert [k for k, *_ in pii.find_pii(f"tel {number}")] == ["national_phone"]
    assert not pii.find_pii(number) and not pii.find_pii(f"isbn tel {number}")


def test_least_score_of_a_row(spark):
    rows = [(1, "visa 4111 1111 1111 1111 and 10.0.0.1 in the version"), (2, "nothing"), (3, "x@y.zz")]
    out = got(pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    least = pii.BASE_SCORE["ip"] - pii.BONUS
    assert out[1]["min_score"] == pytest.approx(least) and out[2]["min_score"] is None and out[3]["min_score"] == pii.BASE_SCORE["email"]


def test_spans_of_a_long_text_take_linear_time():
    import time

    text = "tel 030 1234 5678, " * 40_000
    began = time.perf_counter()
    assert len(pii.find_pii(text)) == 40_000
    assert time.perf_counter() - began < 20


# 5 ------------------------------------------------------------------------------------------------


def shingles(text, lower=False):
    w = WORD.findall(text or "")
    if lower:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints(spark, odd, none):
    docs = sorted(rows_of("documents"), key=lambda d: d["doc_id"])
    mine = got(q.op5_fingerprints(spark, TINY))
    off = []
    for a, b in zip(docs, docs[1:] + docs[:1]):
        n = len(a["text"])
        edited = a["text"][: n - n // 2] + b["text"][: n // 2]
        r = mine[a["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha(edited))
        x, y, z = shingles(a["text"]), shingles(edited), shingles(b["text"])
        for est, n_ in ((r["n_shingles"], len(x)), (r["n_shingles_both"], len(x | z))):
            assert est == n_ if n_ < fingerprints.K else abs(est / n_ - 1) < 0.45
        assert abs(r["contained"] - (len(x & y) / len(x) if x else 1)) < 0.3
        for other, est in ((edited, r["near_edited"]), (b["text"], r["near_next"])):
            x, y = shingles(a["text"]), shingles(other)
            j = len(x & y) / len(x | y)
            off.append(est - j)
            assert abs(est - j) < 0.2
    assert abs(np.mean(off)) < 0.01
    out = fingerprints.fingerprint_pairs(odd).collect()
    assert len(out) == len(ODD) + 1
    by = {r["doc_id"]: r for r in out}
    assert by[11]["fingerprint"] == by[12]["fingerprint"] and by[11]["near_next"] == 1.0
    assert by[1]["fingerprint"] == "" and by[1]["near_next"] == 1.0
    assert fingerprints.fingerprint_pairs(none).count() == 0


def test_sketches_of_parts_make_that_of_the_whole(spark):
    """Above k hashes: parts that overlap by four words have the shingles of the whole between them."""
    w = [f"w{i}" for i in range(3000)]
    parts = [(1, " ".join(w[:1500])), (1, " ".join(w[1496:2500])), (1, " ".join(w[2496:])), (2, " ".join(w)), (3, " ".join(w[:2002]))]
    s = fingerprints.with_sketch(spark.createDataFrame(parts, "g int, text string"), "text")
    out = {r["g"]: r["sketch"] for r in fingerprints.merged(s, ["g"]).collect()}
    assert out[1] == out[2] and len(out[1]) == fingerprints.K
    one = fingerprints.merged(s, ["g"])
    two = one.where("g = 2").select(F.col("sketch").alias("a")).crossJoin(one.where("g = 3").select(F.col("sketch").alias("b")))
    r = two.select(
        fingerprints.distinct_shingles("a").alias("n"), fingerprints.containment("b", "a").alias("in"), fingerprints.containment("a", "b").alias("of"),
        fingerprints.resemblance("a", "b").alias("j"), (fingerprints.merge("a", "b") == F.col("a")).alias("m"),
    ).first()
    assert abs(r["n"] / 2996 - 1) < 0.3 and r["in"] > 0.8 and abs(r["of"] - 2 / 3) < 0.2 and abs(r["j"] - 2 / 3) < 0.15 and r["m"]


@pytest.mark.parametrize("parts", [1, 6])
def test_rows_without_ids_follow_all_others(spark, parts):
    texts = [f"t{i} a b c d e" for i in range(40)]
    rows = [(None, t) for t in texts] + [(5, "five a b c d"), (3, "three a b c d")]
    out = fingerprints.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert len(out) == 42
    edits = {sha(x[: len(x) - len(x) // 2] + y[: len(x) // 2]): (x, y) for _, x in rows for _, y in rows}
    follows = dict(edits[r["edited_sha256"]] for r in out)
    at, ring = "three a b c d", []
    for _ in rows:
        ring.append(at)
        at = follows[at]
    assert ring[:2] == ["three a b c d", "five a b c d"] and sorted(ring) == sorted(t for _, t in rows)


def test_sketches_merge(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (1, "d e f g h i j k"), (2, "x")], "g int, text string")
    s = fingerprints.with_sketch(df, "text")
    out = {r["g"]: r["sketch"] for r in fingerprints.merged(s, ["g"]).collect()}
    whole = {x for r in s.where("g = 1").collect() for x in r["sketch"]}
    assert out[1] == sorted(whole) and len(out[2]) == 1
    c = s.where("g = 1").limit(1).select(fingerprints.containment("sketch", "sketch").alias("c"), fingerprints.distinct_shingles("sketch").alias("n")).first()
    assert (c["c"], c["n"]) == (1.0, 4.0)


# 6 ------------------------------------------------------------------------------------------------


def plain_windows(pairs):
    seen, out = set(), {}
    for k, text in sorted(pairs, key=lambda p: (p[0] is None, p[0])):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        out[k] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_repeated_windows(spark, odd, none):
    docs = [(d["doc_id"], d["text"]) for d in rows_of("documents", "/root/testdata/sf0.01")]
    mine = got(q.op6_substring_dedup(spark, "/root/testdata/sf0.01"))
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in mine.items()} == plain_windows(docs)
    out = substrings.repeated_windows_removed(odd.where("doc_id is null or doc_id <> 5"))
    want = plain_windows([r[:2] for r in ODD if r[0] != 5])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()} == want
    assert substrings.repeated_windows_removed(odd).count() == len(ODD) + 1
    assert substrings.repeated_windows_removed(none).count() == 0


def thue_morse(n):
    """Two words of n letters that collide under every polynomial hash modulo 2**64 once n reaches 1024."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_that_defeat_polynomial_hashes(spark, n):
    a, b = thue_morse(n)
    tail = " ".join(f"w{i}" for i in range(25))
    pairs = [(1, f"{a} {tail}"), (2, f"{b} {tail}")]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    mine = substrings.repeated_windows_removed(df).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in mine} == plain_windows(pairs)
    assert sorted(r["n_removed"] for r in mine) == [0, 25]
    words_ = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert all(r["kept"] for r in minhash.minhash_components(words_).collect())


def test_word_hashes_tell_words_apart():
    words_ = [bytes([c]) * k for c in b"ab" for k in range(1, 200)] + [thue_morse(1 << k)[i].encode() for k in range(1, 13) for i in (0, 1)]
    words_ = sorted(set(words_) | {b"x" * 8 + w for w in words_} | {w + b"x" * 8 for w in words_})
    data = b" ".join(words_)
    start, end = words.word_bounds(data)
    assert [data[i:j] for i, j in zip(start, end)] == words_
    one, two = (words.word_hashes(data, start, end, k) for k in (0, 1))
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words_)
    assert len(set((one ^ two).tolist())) == len(words_)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_rows_of_one_id_in_a_fixed_order(spark, parts, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 200)
    tail = " ".join(f"w{i}" for i in range(25))
    rows = [(3, f"{k} {tail}") for k in range(6)] + [(None, f"n{k} {tail}") for k in range(6)] + [(3, f"0 {tail}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    out = substrings.repeated_windows_removed(df).collect()
    assert len(out) == len(rows) and sum(r["n_removed"] == 0 for r in out) == 1
    now = sorted((str(r["doc_id"]), r["kept_sha256"], r["n_removed"]) for r in out)
    assert ORDERS.setdefault("rows", now) == now


ORDERS = {}


def test_shards_grow_with_the_corpus():
    assert substrings.shard_size(64, 4 * 10**8) == substrings.SHARD_CELLS
    blocks, cells = 10**5, 8 * 10**11
    size = substrings.shard_size(blocks, cells)
    assert size == substrings.MOST_CELLS


def test_many_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(substrings, "SHARD_CELLS", 1 << 16)
    docs = [(d["doc_id"], d["text"]) for d in rows_of("documents")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    mine = substrings.repeated_windows_removed(df).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in mine} == plain_windows(docs)


def test_pack():
    for x in ([], [0], [3, 3, 9, 70000, 1 << 40]):
        assert substrings.unpack(substrings.pack(np.array(x, np.uint64))).tolist() == x


# 7 ------------------------------------------------------------------------------------------------


def plain_url(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1])
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and m[2].startswith(p)]
    return (host, m[2], *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    mine = got(q.op7_url_filter(spark, TINY), "page_id")
    for r in rows_of("pages"):
        m = mine[r["page_id"]]
        assert (m["host"], m["path"], m["rule"], m["verdict"]) == plain_url(r["url"])
    urls = [None, "", "x", "http://", "HTTP://A.Example.ORG/es/x?y#z", "a://example.org/en/1", "a://xexample.org/es/", "b://com/de/", "c://example.org", "d://org?/es/", "e://a.com:80/de/", "f://x.com/fr/é", "g://..org//"]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string")
    mine = got(urlfilter.judge_urls(df), "page_id")
    for i, u in enumerate(urls):
        assert tuple(mine[i][c] for c in ("host", "path", "rule", "verdict")) == plain_url(u), u
    assert urlfilter.judge_urls(df.where("1 = 0")).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("crc32(key) % 50 = 0")
    c = urlfilter.build_cascade(listed, universe)
    assert len(c.levels) > 1
    assert universe.where(c.has(F.col("key"))).exceptAll(listed).count() == 0
    assert universe.where(~c.has(F.col("key"))).count() == universe.count() - listed.count()


# 8 ------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    """Fill to one level for each unit of weight: the level at which the shares add up to 150 %."""
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    low, high = 0.0, 2.0 * max(sizes, default=0) + 1
    for _ in range(200):
        mid = (low + high) / 2
        full = sum(min(2 * s, mid * w) for s, w in zip(sizes, weight))
        low, high = (mid, high) if full < 1.5 * sum(sizes) else (low, mid)
    return [min(2.0 * s, high * w) for s, w in zip(sizes, weight)]


@pytest.mark.parametrize("sizes", [[10, 1000, 1000], [5], [0, 0], [7, 0, 3, 900, 1, 1, 50], list(range(1, 40)), [1000, 1, 1, 1, 1, 1, 1]])
def test_targets_fill_to_one_level(spark, sizes):
    want = plain_targets(sizes)
    assert np.allclose(mixing.targets(sizes), want, atol=1e-6)
    df = spark.createDataFrame(list(enumerate(sizes)), "rank long, words long")
    wide = {r["rank"]: r["target"] for r in mixing.wide_targets(df).collect()}
    assert [wide[i] for i in range(len(sizes))] == mixing.targets(sizes)


def draws_of(r):
    return [tuple(map(int, d.split(":"))) for d in r["draws"].split(",") if d]


def test_shards_draw_what_the_tree_gave(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    plan = mixing.plan_mix(docs)
    draws = plan.draws.collect()
    ranks = sorted({r["rank"] for r in draws})
    quota = Counter(r["rank"] for r in draws)
    tree = mixing.split_tree(np.array([quota[k] for k in ranks]), mixing.SHARDS, np.random.default_rng(mixing.SEED))
    per = Counter((r["shard"], r["rank"]) for r in draws)
    assert all(per[s, k] == tree[s, i] for s in range(mixing.SHARDS) for i, k in enumerate(ranks))
    whole = Counter(r["shard"] for r in draws)
    assert max(whole.values()) - min(whole[s] for s in range(mixing.SHARDS)) <= 1
    of = {(r["rank"], r["block"], r["turn"]): r["shard"] for r in draws}
    assert len(of) == len(draws)  # a block goes to one shard in each pass
    place = {r["doc_id"]: (r["rank"], r["block"]) for r in plan.sizes.collect()}
    mine = mixing.mixed_sizes(docs).collect()
    assert any(r["draws"] for r in mine)
    for r in mine:
        assert sum(w for _, _, w in draws_of(r)) == r["taken"]
        assert all(of[(*place[r["doc_id"]], turn)] == shard for turn, shard, _ in draws_of(r))


def test_many_sources_in_runs(spark, monkeypatch):
    rows = [(i, f"s{i % 50:02}", "w " * (1 + i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plain = {r["doc_id"]: r for r in mixing.mixed_sizes(df).collect()}
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 5)
    wide = {r["doc_id"]: r for r in mixing.mixed_sizes(df).collect()}
    plan = mixing.plan_mix(df)
    whole = Counter(r["shard"] for r in plan.draws.collect())
    assert max(whole.values()) - min(whole[s] for s in range(mixing.SHARDS)) <= 1
    took, goal = Counter(), {}
    for k, r in wide.items():
        assert (r["size"], r["source_size"], r["target"]) == (plain[k]["size"], plain[k]["source_size"], plain[k]["target"])
        took[rows[k][1]] += r["taken"]
        goal[rows[k][1]] = r["target"]
    assert all(abs(took[s] - goal[s]) <= 1 for s in goal)


def test_mix_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(11))
    rows = [(None, "a", f"{i} {text}", "x", 1) for i in range(30)] + [(1, "a", text, "y", 2)] * 7 + [(1, "b", text, "z", 3), (2, None, text, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _words string, _order int")
    one, two = (sorted(map(tuple, mixing.mixed_sizes(df.repartition(k)).collect()), key=repr) for k in (1, 5))
    assert one == two and len(one) == len(rows)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(r[4] for r in one)


def test_mix(spark, odd, none):
    base = "/root/testdata/sf0.01"
    docs = rows_of("documents", base)
    mine = got(q.op8_source_mix(spark, base))
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    per = Counter()
    for d in docs:
        per[d["source"]] += size[d["doc_id"]]
    names = sorted(per)
    goal = dict(zip(names, plain_targets([per[n] for n in names])))
    took = Counter()
    for d in docs:
        r = mine[d["doc_id"]]
        assert r["size"] == size[d["doc_id"]] and r["source_size"] == per[d["source"]]
        assert abs(r["target"] - goal[d["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        took[d["source"]] += r["taken"]
    assert all(abs(took[n] - goal[n]) <= 1 for n in names)
    assert abs(sum(took.values()) - 1.5 * sum(size.values())) < len(names)
    again = got(q.op8_source_mix(spark, base))
    assert all(again[k]["taken"] == r["taken"] for k, r in mine.items())
    out = mixing.mixed_sizes(odd).collect()
    assert len(out) == len(ODD) + 1 and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mixed_sizes(none).count() == 0
    assert mixing.mix_documents(none).count() == 0


def test_mix_rows_match_the_plan(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    mix = mixing.mix_documents(docs)
    assert mix.columns == docs.columns
    took = Counter()
    for r in mix.collect():
        took[r["doc_id"]] += len(WORD.findall(r["text"]))
    want = {r["doc_id"]: r["taken"] for r in mixing.mixed_sizes(docs).collect() if r["taken"]}
    assert dict(took) == want


def test_split_tree():
    quota = np.array([100, 0, 7, 33])
    t = mixing.split_tree(quota, 8, np.random.default_rng(1))
    assert t.sum(0).tolist() == quota.tolist() and t.sum(1).max() - t.sum(1).min() <= 1 and (t >= 0).all()


# 9 ------------------------------------------------------------------------------------------------


def test_licenses(spark, odd, none):
    text = "MIT Licence\n\nCopyright (c) 2020 Someone\n\n" + licenses.MIT.upper().replace("\n", "  \n").replace("SUBLICENSE", "sub-licence")
    rows = [(1, text), (2, licenses.MIT + " more"), (3, None), (4, "x\n* RELEASED under the M.I.T. license.\n"), (5, "x\n -- Released under the MIT licence!\nLicensed under CC BY-NC 4.0")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, license_id string")
    out = got(licenses.license_scan(df))
    assert [out[i]["license_id"] for i in range(1, 6)] == ["MIT", None, None, None, None]
    assert out[5]["notices"] == "CC-BY-NC-4.0,MIT" and out[5]["n_notices"] == 2 and out[4]["n_notices"] == 0
    assert licenses.license_scan(odd).count() == len(ODD) + 1
    assert licenses.license_scan(none).count() == 0


def test_licenses_are_found_per_row(spark, monkeypatch):
    rows = [(1, "nothing"), (1, "x\nLicensed under CC BY-NC 4.0"), (None, "SPDX-License-Identifier: GPL-3.0-or-later"), (None, ""), (1, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted((r["doc_id"] or 0, r["n_notices"], r["notices"]) for r in licenses.license_scan(df).collect())
    assert plain == [(0, 0, ""), (0, 1, "GPL-3.0"), (1, 0, ""), (1, 0, ""), (1, 1, "CC-BY-NC-4.0")]
    monkeypatch.setattr(licenses, "MAX_LITERAL", 5)
    monkeypatch.setattr(licenses, "MAX_BROADCAST", 5)
    known = licenses.known_digests(spark).select("digest", "license_id", "kind")
    joined = sorted((r["doc_id"] or 0, r["n_notices"], r["notices"]) for r in licenses.license_scan(df, known).collect())
    assert joined == plain


PUBLISHED = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0",
}


def test_published_texts_are_found(spark):
    """Whole texts as distributions ship them, with other case, punctuation, breaks and holders."""
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    if not folder.exists():
        pytest.skip("no published texts here")
    rows, want = [], []
    for name, spdx in PUBLISHED.items():
        text = (folder / name).read_text()
        for form in (text, text.upper(), "  " + text.replace("\n", "\r\n"), text.replace("license", "licence").replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Some One")):
            rows.append((len(rows), form))
            want.append(spdx)
        rows.append((len(rows), text + "\nand more"))
        want.append(None)
    texts = {"ISC": "Copyright (c) 2001 A\n\n" + licenses.ISC, "Unlicense": licenses.UNLICENSE, "Zlib": "zlib License\n\n(C) 1995 B\n\n" + licenses.ZLIB, "0BSD": licenses.BSD_0}
    for spdx, text in texts.items():
        rows.append((len(rows), text))
        want.append(spdx)
    out = got(licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [out[k]["license_id"] for k in range(len(rows))] == want


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql_twins(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    want = c.execute(q.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    mine = q.queries()[name](spark, TINY)
    assert sorted(cols) == sorted(mine.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in cols)) for r in mine.collect())


def test_sql_twin_of_planted_vectors(spark):
    """The generated vectors hold no pair that links, so the twin is also held to some that do."""
    import duckdb

    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 32))
    near = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.2, 0.4, 0.6)])
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(near)]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] + [1.0] * 31), (903, [1.0, None])]
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = c.execute(q.oracle_sql()["op3_embedding_near_dedup"])
    cols = [d[0] for d in want.description]
    want = sorted(want.fetchall())
    mine = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sum(not r[cols.index("kept")] for r in want) >= 40
    assert sorted(tuple(r[c] for c in cols) for r in mine.collect()) == want


# 10 -----------------------------------------------------------------------------------------------


def plain_near(pairs):
    sets = [shingles(t, lower=True) for _, t in pairs]
    inv = defaultdict(list)
    links = []
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in inv[x])
        links += [(j, i) for j, k in common.items() if 100 * k >= 75 * (len(s) + len(sets[j]) - k)]
        for x in s:
            inv[x].append(i)
    comp = components(len(pairs), links)
    return {k: (len(s), pairs[comp[i]][0]) for i, ((k, _), s) in enumerate(zip(pairs, sets))}


def test_near_documents(spark, odd, none):
    docs = sorted((d["doc_id"], d["text"]) for d in rows_of("documents", "/root/testdata/sf0.01"))
    mine = got(q.op10_minhash_near_dedup(spark, "/root/testdata/sf0.01"))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in mine.items()} == plain_near(docs)
    out = minhash.minhash_components(odd).collect()
    assert len(out) == len(ODD) + 1
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    want = plain_near([(r[0], r[1]) for r in ODD if r[0] is not None])
    assert {k: v for k, v in by.items() if k is not None} == want and by[None] == (1, None)
    assert minhash.minhash_components(none).count() == 0
    left = minhash.near_duplicates_removed(odd)
    assert left.columns == odd.columns
    want_ids = sorted((k for k, (_, c) in want.items() if k == c)) + [None]
    assert sorted((r["doc_id"] for r in left.collect()), key=lambda k: (k is None, k)) == want_ids
    assert mixing.mix_documents(odd).where("doc_id is null").count() > 0


@pytest.mark.parametrize("star", [0, 4, 256])
def test_large_lists_and_clusters_in_blocks(spark, monkeypatch, star):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 8)
    monkeypatch.setattr(minhash, "SET_BLOCK", 300)
    if star:
        monkeypatch.setattr(minhash, "STAR", star)
    else:  # pass one finds nothing: every link is left to the lists
        monkeypatch.setattr(minhash, "_stars", lambda ranked: ranked.selectExpr("rep as unit", "0 as part", "rep", "0L as half"))
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    pairs = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 8)):
            w[k] = f"z{rng.integers(1e6)}"
        pairs.append((i, " ".join(w)))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    mine = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.minhash_components(df).collect()}
    assert mine == plain_near(pairs)


def test_a_chain_of_half_similar_documents_is_linear(spark, monkeypatch):
    """Neighbours share half of their shingles: none link, and the texts compared grow with the chain."""
    seen = []
    plain = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda units, texts: seen.append(units.count()) or plain(units, texts))
    counts = {}
    for n in (300, 1200):
        seen.clear()
        text = [" ".join(f"w{i * 32 + k}" for k in range(100)) for i in range(n)]
        df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
        out = minhash.minhash_components(df).collect()
        assert len(out) == n and all(r["kept"] and r["n_shingles"] == 96 for r in out)
        counts[n] = sum(seen)
    assert counts[300] > 300 and counts[1200] < 4.6 * counts[300] and counts[1200] < 10 * 1200


def test_exact_sets_are_the_shingles():
    texts = ["a b c d e f", "A b c D e f g", "", None, "a b", "a  b", "b a", "x " * 9, "a b c d e f a b c d e f"]
    h, off = minhash.exact_sets(texts)
    sets = [shingles(t, lower=True) for t in texts]
    mine = [set(h[i:j].tolist()) for i, j in zip(off, off[1:])]
    assert [len(s) for s in mine] == [len(s) for s in sets]
    assert all(len(mine[i] & mine[j]) == len(sets[i] & sets[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_deduplication_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "p", "q"), (2, "a b c d e f", "r", "s")], "doc_id long, text string, _copy string, _kept_id string")
    left = minhash.near_duplicates_removed(df)
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [(1, "a b c d e f", "p", "q")]


# pipeline -----------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    left = cp.quality_classifier(spark, docs, TINY)
    assert left.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, spark.read.parquet(f"{TINY}/labels.parquet")).collect()}
    left = {r["doc_id"] for r in left.collect()}
    assert left == {k for k, p in scores.items() if p}
    kept = cp.minhash_near_dedup(spark, docs, TINY)
    want = plain_near(sorted((k, r["text"]) for k, r in rows.items()))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, (_, c) in want.items() if k == c)
    masked = cp.pii(spark, docs, TINY).collect()
    assert all(not plain_pii(r["text"]) and r["n_chars"] == len(r["text"]) for r in masked)
    assert all(r["text"] == rows[r["doc_id"]]["text"] for r in masked if not pii.find_pii(rows[r["doc_id"]]["text"]))
    out = cp.run(spark, TINY)
    got_rows = out.collect()
    assert got_rows and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in got_rows)
    assert {r["doc_id"] for r in got_rows} <= left
