"""Columns that say why a url must not be fetched, and whether a path stays in its folder.

Names are not resolved: a check of a table must not ask a name server for each row. A fetcher repeats the check on the
address that it connects to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes that may be fetched, hosts of cloud metadata and of the machine itself, and address ranges that
# are private, reserved, local or shared (first address, bits of the prefix).
SCHEMES = ("http", "https")
BLOCKED_HOSTS = ("metadata.google.internal", "metadata.google.com", "localhost")
BLOCKED_RANGES = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("240.0.0.0", 4),
)
#: IPv6: unspecified, loopback, mapped, documentation, unique local and link-local addresses.
BLOCKED_V6 = r"^(::1?|::ffff:.*|2001:db8:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$"
#: An IPv4 address inside the prefix of the NAT64 gateway counts as that address.
NAT64 = r"^64:ff9b::([0-9.]+)$"


def url_host(url: Column) -> Column:
    """The host of a url in lower case, without user, port, brackets and final dot; empty where there is none."""
    authority = F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    return F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(host, r"\.?(:[0-9]*)?$", ""))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocked_v4(host: Column) -> Column:
    parts = F.split(host, r"\.")
    number = sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0))
    low = [(sum(int(x) * 256 ** (3 - k) for k, x in enumerate(first.split("."))), 2 ** (32 - bits)) for first, bits in BLOCKED_RANGES]
    ranges = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(a + n - 1).cast("long").alias("z")) for a, n in low))
    hit = _bound(number, lambda n: F.exists(ranges, lambda r: n.between(r["a"], r["z"])))
    # other spellings of an address (fewer parts, one number, hexadecimal, leading zeros) are refused as they are
    plain = host.rlike(r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(?!$)|$)){4}$") & ~host.rlike(r"(^|\.)0[0-9]")
    return F.when(plain, F.coalesce(hit, F.lit(True))).otherwise(host.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+))*$"))


def url_refusal(url: Column) -> Column:
    """``scheme``, ``host`` or ``address`` where a url must not be fetched, else null. A null url is refused by its scheme."""
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))

    def judged(host: Column) -> Column:
        named = F.when(host.isin(*BLOCKED_HOSTS) | host.endswith(".localhost"), "host")
        return named.when(_blocked_v4(host) | host.rlike(BLOCKED_V6), "address")

    def unwrapped(host: Column) -> Column:
        return F.when(host.rlike(NAT64), F.regexp_extract(host, NAT64, 1)).otherwise(host)

    return F.when(~scheme.isin(*SCHEMES), "scheme").otherwise(_bound(_bound(url_host(url), unwrapped), judged))


def resolved(path: Column) -> Column:
    """A path without empty parts, ``.`` and ``..``, from the root on."""
    step = lambda acc, p: (
        F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin("", "."), acc).otherwise(F.concat(acc, F.array(p)))
    )
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def inside(path: Column, base: str) -> Column:
    """Whether a path, relative to ``base`` or absolute, names ``base`` or something in it. Links aren't followed."""
    base = "/" + "/".join(p for p in base.split("/") if p)
    full = resolved(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path)))
    return (full == base) | full.startswith(base.rstrip("/") + "/")
