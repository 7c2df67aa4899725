"""Scalar column functions: ids, labels, paths, tokens, sizes. Built-in expressions unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Extensions by language family, code and image extensions.
FAMILIES = {
    "python": ("py", "pyi"), "web": ("js", "jsx", "ts", "tsx", "mjs", "cjs", "vue", "svelte"), "jvm": ("java", "kt", "scala", "groovy"),
    "native": ("c", "h", "cc", "cpp", "hpp", "cxx", "m", "mm"), "go": ("go",), "rust": ("rs",), "ruby": ("rb",), "dotnet": ("cs",),
    "php": ("php",), "swift": ("swift",), "lua": ("lua",), "shell": ("sh", "bash", "zsh"), "sql": ("sql",),
}
IMAGES = ("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp")
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have how i if in into is it its me my of on or our "
    "should so than that the their them then there these they this to was we were what when where which who why will with would you your"
).split()


def by_map(key: Column, values: dict) -> Column:
    """CASE over a small fixed mapping; null where the key isn't in it."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def normalize_id(s: str) -> str:
    """NFKC, runs of non-word characters to one underscore, none at the ends, case-folded."""
    import re

    s = unicodedata.normalize("NFKC", s)
    return re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", s)).strip("_").casefold()


@F.pandas_udf(StringType())
def normalize_id_udf(s: pd.Series) -> pd.Series:
    """Unicode form of ids; Spark has no built-in normalisation."""
    return s.map(lambda x: None if x is None else normalize_id(x))


def ascii_id(c: Column) -> Column:
    """The same for ASCII input, without Python."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_|_$", ""))


def make_id(*parts: Column) -> Column:
    """Id of non-empty parts, each without underscores at its ends."""
    clean = [F.regexp_replace(p, "^_+|_+$", "") for p in parts]
    return ascii_id(F.concat_ws("_", *(F.when(p != "", p) for p in clean)))


@F.pandas_udf(StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    """NFKD without combining marks, lower case."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower())


@F.pandas_udf(StringType())
def norm_label_udf(s: pd.Series) -> pd.Series:
    """Label for comparing: NFKC, case-folded, runs of non-word characters and underscores to a space."""
    import re

    return s.map(lambda x: None if x is None else re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", x).casefold()).strip())


def norm_label(c: Column) -> Column:
    """The same for ASCII labels, without Python."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Search tokens of a lower-case text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+"), F.lit(0))


def query_terms(question: str) -> list[str]:
    """Terms of a question: short words and stopwords go, unless nothing would be left; Han runs as bigrams."""
    import re

    text = "".join(c for c in unicodedata.normalize("NFKD", question) if not unicodedata.combining(c)).lower()
    words: list[str] = []
    for w in re.findall(r"\w+", text):
        for han, other in re.findall(r"([一-鿿]+)|([^一-鿿]+)", w):
            if han:
                words += [han[i : i + 2] for i in range(max(1, len(han) - 1))]
            else:
                words.append(other)
    kept = [w for w in words if not (w.isascii() and w.isalpha() and len(w) <= 2) and w not in STOPWORDS]
    return list(dict.fromkeys(kept or words))


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters; a shorter text as a whole."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substr(c, i, F.lit(3)))
    return F.when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(runs))


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars = F.split(c, "")
    n = F.length(c)
    counts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    total = F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(total)


def one_edit(a: Column, b: Column) -> Column:
    """Whether two texts of equal length differ by at most one substitution or neighbouring swap."""
    n = F.length(a)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i, j = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    swap = (
        (F.size(at) == 2) & (j == i + 1)
        & (F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1))) & (F.substr(a, j, F.lit(1)) == F.substr(b, i, F.lit(1)))
    )
    return (F.length(a) == F.length(b)) & ((F.size(at) <= 1) | swap)


#: Fixed value: how a label splits into stem and ending.
_VARIANT = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"


def variant_pair(a: Column, b: Column) -> Column:
    """Short labels of one stem with different endings, such as numbered siblings."""
    stem, end = (F.regexp_extract(a, _VARIANT, i) for i in (1, 2))
    stem2, end2 = (F.regexp_extract(b, _VARIANT, i) for i in (1, 2))
    return (stem != "") & (stem == stem2) & (end != end2)


def numeric_tokens(c: Column) -> Column:
    """Sorted numbers in a text, without leading zeros."""
    return F.array_sort(F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0)), lambda x: F.ltrim(x, F.lit("0"))))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def language_family(path: Column) -> Column:
    """Null for unknown extensions."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for name, exts in FAMILIES.items():
        out = F.when(ext.isin(*exts), F.lit(name)).otherwise(out)
    return out


def file_category(path: Column) -> Column:
    """code, paper, image or doc."""
    ext = extension(path)
    code = [e for exts in FAMILIES.values() for e in exts]
    return F.when(ext.isin(*code), "code").when(ext == "pdf", "paper").when(ext.isin(*IMAGES), "image").otherwise("doc")


def top_dir(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def is_test_path(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    name = F.lower(basename(path))
    segment = F.exists(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: p.isin("test", "tests", "__tests__", "spec", "testing"))
    return segment | name.rlike(r"^test_.*|.*_test\.[a-z]+$|.*\.(test|spec)\.[a-z]+$|^conftest\.py$")


def bare_path(path: Column) -> Column:
    """A path without leading dots and slashes; this takes the dot of hidden folders too."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[./]+", "")


def sanitized_label(c: Column, cap: int = 256) -> Column:
    return F.substring(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), 1, cap)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def content_hash(body: Column, path: Column) -> Column:
    """Digest of the body, a NUL and the lower-case path; front matter of Markdown doesn't count."""
    body = F.when(F.lower(path).endswith(".md"), F.regexp_replace(body, r"(?s)\A---\n.*?\n---\n", "")).otherwise(body)
    return F.sha2(F.concat(body, F.char(F.lit(0)), F.lower(path)), 256)


def half_life(age_days: Column, days: float = 30.0) -> Column:
    """Decay weight; no date counts fully, a future one as today."""
    return F.when(age_days.isNull(), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / days))


def callable_key(label: Column) -> Column:
    """Label of a callable for resolving calls: no parentheses, no leading dot, lower case."""
    return F.lower(F.regexp_replace(label, r"^\.|\(\)$", ""))


def is_sentence(c: Column) -> Column:
    return ((F.length(c) >= 80) | (word_count(c) >= 8)) & c.rlike(r"[.!?:]")


def size_literal(c: Column, default: int = 0) -> Column:
    """Bytes of texts such as ``640MB``; what isn't one, null included, gives the default."""
    n = F.regexp_extract(F.trim(c), r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)i?b?$", 1)
    unit = F.upper(F.regexp_extract(F.trim(c), r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)i?b?$", 2))
    scale = by_map(unit, {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40})
    return F.when(n.isNull() | (n == ""), F.lit(default)).otherwise((n.try_cast("double") * scale).cast("long")).cast("long")


def node_kind(label: Column, file_type: Column, source_file: Column) -> Column:
    """What a node is, the first rule that fits."""
    return (
        F.when(file_type.isin("rationale", "concept"), "concept")
        .when(label.startswith(".") & label.endswith("()"), "method")
        .when(label.endswith("()"), "function")
        .when(label == basename(source_file), "file")
        .when(file_type.isin("document", "paper", "image"), file_type)
        .when(label.rlike("^[A-Z][A-Za-z0-9]*$"), "class")
        .otherwise("symbol")
    )


def html_text(html: Column, cap: int = 8000) -> Column:
    """Visible text: scripts, styles and tags go, white space collapses, the first ``cap`` characters stay."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, cap)


def url_kind(url: Column) -> Column:
    """What a url points to."""
    u = F.lower(url)
    return (
        F.when(u.contains("arxiv.org"), "arxiv")
        .when(u.rlike(r"(twitter|//x)\.com/"), "tweet")
        .when(u.rlike(r"youtube\.com/|youtu\.be/"), "youtube")
        .when(u.contains("github.com/"), "github")
        .when(u.rlike(r"\.pdf($|[?#])"), "pdf")
        .when(u.rlike(r"\.(png|jpe?g|gif|webp)($|[?#])"), "image")
        .otherwise("webpage")
    )
