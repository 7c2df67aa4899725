"""Personal data: patterns propose spans, validators confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are reported whenever their pattern and validator hold. Two
further kinds need more: an IBAN must pass mod-97, and a national phone number without ``+`` must
have a word such as "tel" close by.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import text_chunks

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, in the order of ties.
ADDED = ("iban", "national_phone")

# The patterns below find what the plain ones would, in linear time: a run of digits is entered at
# its first digit only, and the local part of an address is read backwards from its "@".
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z-])")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"\w+")
#: Lower-case words that make a span of a kind likelier, and those that make it less so.
CONTEXT = {
    "email": {"mail", "email", "e", "contact", "kontakt", "correo", "courriel"},
    "ip": {"ip", "server", "host", "address", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit"},
    "phone": {"tel", "phone", "call", "fax", "mobile", "telefon", "telefono", "telephone"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta"},
    "national_phone": {"tel", "phone", "call", "fax", "mobile", "telefon", "telefono", "telephone"},
}
AGAINST = {"version", "isbn", "order", "invoice", "serial", "example"}
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.75, "iban": 0.8, "national_phone": 0.35}
#: Characters on either side in which context words count, what they add, and the bar for added kinds.
REACH, BONUS, BAR = 40, 0.25, 0.5


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of IBANs (ISO 13616)."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    found, low = [], 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > low and _LOCAL.fullmatch(text, start - 1, start):
                start -= 1
            if start < at:
                found.append((start, m.end()))
                low = m.end()
                at = text.find("@", low)
                continue
        at = text.find("@", at + 1)
    return found


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m.groups()))]


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    found, at = [], 0
    while m := _IBAN.search(text, at):
        s = m[0]
        # words in capitals may follow the number: the longest cut at a space that passes
        ends = [len(s), *(k for k in range(len(s) - 1, 14, -1) if s[k] == " ")]
        good = next((e for e in ends if mod97(s[:e])), None)
        if good:
            found.append((m.start(), m.start() + good))
        # the rest of an accepted match, or what follows the first word of another, may hold the next number
        at = m.start() + (good or (s.find(" ") + 1 or len(s)))
    return found


def national_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _NATIONAL.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 11]


_FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "national_phone": national_phones}


def score(text: str, kind: str, start: int, end: int) -> float:
    """Likelihood of a span, 0 to 1: the kind's base moved by the words around it."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - REACH) : start] + " " + text[end : end + REACH])}
    s = BASE_SCORE[kind] + BONUS * bool(near & CONTEXT[kind]) - BONUS * bool(near & AGAINST)
    return min(1.0, max(0.0, s))


def find_pii(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; code points, end exclusive.

    Base kinds may overlap one another. An added span never overlaps a base span.
    """
    if not text:
        return []
    base = []
    digits = any(c in text for c in "0123456789")
    for rank, kind in enumerate(KINDS):
        if kind == "email" or digits:
            base += [(s, rank, kind, e) for s, e in _FINDERS[kind](text)]
    more = []
    if digits:
        for rank, kind in enumerate(ADDED, len(KINDS)):
            taken = sorted((b[0], b[3]) for b in [*base, *more])
            starts = [s for s, _ in taken]
            reach = [0, *accumulate((e for _, e in taken), max)]  # how far the first k spans go
            for s, e in _FINDERS[kind](text):
                if reach[bisect_left(starts, e)] <= s and score(text, kind, s, e) >= BAR:
                    more.append((s, rank, kind, e))
    return [(k, s, e, score(text, k, s, e)) for s, _, k, e in sorted(base + more)]


def mask(text: str | None) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets; overlaps by the first kind."""
    spans = find_pii(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts and digests of the spans of each row of ``docs``.

    Null and empty texts have no spans (digest of the empty string). ``min_score`` is the least score
    of a span, null without spans. Other columns are ignored; repeated rows each count.
    """

    def work(batches):
        for part in text_chunks(batches):
            columns = [[] for _ in range(len(KINDS) + 3)]
            for text in part.column("text").to_pylist():
                spans = find_pii(text)
                said = [f"{k}:{s}:{e}" for k, s, e, _ in spans]
                base = ",".join(x for x, y in zip(said, spans) if y[0] in KINDS)
                n = [sum(y[0] == k for y in spans) for k in KINDS]
                least = min((y[3] for y in spans), default=None)
                for c, v in zip(columns, (*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(said), least)):
                    c.append(v)
            kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.float64()]
            arrays = [part.column("doc_id"), *map(pa.array, columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "min_score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return src.mapInArrow(work, f"doc_id long, {counts}, base_sha256 string, spans string, min_score double")


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by ``<kind>``; all other columns as they are.

    A numeric column ``n_chars`` is brought up to date where there is one. Null and empty texts stay as they are,
    repeated rows each count, null ids and columns of any names pass through, and an empty table gives no rows.
    """

    src = docs.withColumn("text", F.col("text").cast("string"))

    def work(batches):
        for part in text_chunks(batches):
            at = part.schema.get_field_index("text")
            texts = pa.array([mask(x) for x in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:at], texts, *part.columns[at + 1 :]], part.schema.names)

    out = src.mapInArrow(work, ", ".join(f"`{c}` {t}" for c, t in src.dtypes))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
