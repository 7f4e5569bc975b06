"""URL checks with browser URL rules, as column expressions.

Plain ``https://host.tld/path`` text takes the short branches; percent-encoded and
non-ASCII hosts, IPv4 shorthand and IPv6 are worked out only where they occur.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outboxlake.functions.variant import Getter, bind

# Schemes whose authority is parsed as a domain or IP address.
SPECIAL_SCHEMES = ("http", "https", "ws", "wss", "ftp", "file")

# Names refused as private.
PRIVATE_NAMES = ("localhost",)
PRIVATE_SUFFIXES = (".local", ".localhost", ".internal", ".lan", ".home.arpa")

# Private IPv4 blocks as (first, last) address.
PRIVATE_V4 = (
    ("0.0.0.0", "0.0.0.0"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.168.0.0", "192.168.255.255"),
)

# Private IPv6 blocks by the first 16 bits (first, last).
PRIVATE_V6 = ((0xFC00, 0xFDFF), (0xFE80, 0xFEBF))

MALFORMED = "malformed"
PRIVATE = "private"
PUBLIC = "public"

_FORBIDDEN_HOST = r"[\x00\t\n\r #/:<>?@\[\\\]^|]"
_FORBIDDEN_DOMAIN = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]"
_PLAIN_DOMAIN = r"^(?:[a-z0-9-]+\.)*[a-z][a-z0-9-]*\z"
_V4_TAIL = r"^(.*:)(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\z"
_TOO_BIG = 1 << 33


def _v4_number(dotted: str) -> int:
    value = 0
    for part in dotted.split("."):
        value = value * 256 + int(part)
    return value


def _between(value: Column, blocks) -> Column:
    found = F.lit(False)
    for low, high in blocks:
        found = found | value.between(low, high)
    return found


def private_v4(address: Column) -> Column:
    return _between(address, [(_v4_number(a), _v4_number(b)) for a, b in PRIVATE_V4])


def split_stage(c: Getter) -> dict[str, Column]:
    url = c("_url")
    cleaned = F.regexp_replace(
        F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", ""
    )
    return {"_clean": F.when(url.rlike(r"^[!-~]*\z"), url).otherwise(cleaned)}


def scheme_stage(c: Getter) -> dict[str, Column]:
    return {"_scheme": F.lower(F.regexp_extract(c("_clean"), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))}


def authority_stage(c: Getter) -> dict[str, Column]:
    clean, scheme = c("_clean"), c("_scheme")
    skip_slashes = F.regexp_extract(clean, r"(?s)^[^:]*:[/\\]*([^/\\?#]*)", 1)
    file_host = F.regexp_extract(clean, r"(?s)^[^:]*:[/\\]{2}([^/\\?#]*)", 1)
    other = F.regexp_extract(clean, r"(?s)^[^:]*://([^/?#]*)", 1)
    return {
        "_special": scheme.isin(*SPECIAL_SCHEMES),
        "_authority": F.when(scheme == "file", file_host)
        .when(scheme.isin(*SPECIAL_SCHEMES), skip_slashes)
        .otherwise(other),
        "_no_authority": (scheme == "file") | ~clean.rlike(r"(?s)^[^:]*://"),
    }


def host_port_stage(c: Getter) -> dict[str, Column]:
    authority = c("_authority")
    with_user = authority.contains("@") & (c("_scheme") != "file")
    return {
        "_userinfo": F.when(with_user, F.regexp_extract(authority, r"(?s)^(.*)@", 1)),
        "_host_port": F.when(with_user, F.regexp_replace(authority, r"(?s)^.*@", "")).otherwise(
            authority
        ),
    }


def host_stage(c: Getter) -> dict[str, Column]:
    pattern = r"(?s)^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?\z"
    port = F.regexp_replace(F.regexp_extract(c("_host_port"), pattern, 2), "^0+", "")
    raw = F.regexp_extract(c("_host_port"), pattern, 1)
    in_range = (F.length(port) <= 4) | ((F.length(port) == 5) & (port <= "65535"))
    return {
        "_host_port_ok": c("_host_port").rlike(pattern) & in_range,
        "_raw_host": raw,
        "_host": F.when(raw.rlike(r"^[!-$&-~]*\z") | raw.startswith("["), F.lower(raw)).otherwise(
            _decoded(raw)
        ),
    }


def _decoded(raw: Column) -> Column:
    """Percent-decoded, mapped to ASCII and lowered; NULL if that fails."""
    decoded = F.when(
        raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    ).otherwise(raw)
    mapped = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), decoded, F.lit(1))
    return F.lower(F.when(decoded.rlike(r"^[\x00-\x7f]*\z"), decoded).otherwise(mapped))


def host_kind_stage(c: Getter) -> dict[str, Column]:
    host = c("_host")
    domain = F.when(host.isNull() | host.rlike(_FORBIDDEN_DOMAIN) | (host == ""), MALFORMED)
    last = F.regexp_extract(host, r"(?s)(?:^|\.)([^.]*)\.?\z", 1)
    by_name = F.when(private_name(host), PRIVATE).otherwise(PUBLIC)
    kind = (
        F.when(host.rlike(_PLAIN_DOMAIN), by_name)
        .when(host.startswith("["), v6_kind(host))
        .when(domain.isNotNull(), domain)
        .when(last.rlike(r"^(?:[0-9]+|0x[0-9a-f]*)\z"), v4_kind(host))
        .otherwise(by_name)
    )
    opaque = F.when(
        c("_raw_host").startswith("["), v6_kind(F.lower(c("_raw_host")))
    ).when(c("_raw_host").rlike(_FORBIDDEN_HOST), MALFORMED).otherwise(PUBLIC)
    bare_user = c("_userinfo").isNotNull() & (c("_host_port") == "")
    bare_port = (c("_raw_host") == "") & (c("_host_port") != "")
    windows_drive = c("_authority").rlike(r"^[A-Za-z][:|]\z")
    return {
        "_host_kind": F.when(c("_scheme") == "", MALFORMED)
        .when(
            c("_scheme") == "file",
            F.when((c("_authority") == "") | windows_drive, PUBLIC)
            .when(c("_host_port").contains(":") & ~c("_host").startswith("["), MALFORMED)
            .otherwise(kind),
        )
        .when(c("_special"), F.when(~c("_host_port_ok"), MALFORMED).otherwise(kind))
        .when(c("_no_authority"), PUBLIC)
        .when(~c("_host_port_ok") | bare_user | bare_port, MALFORMED)
        .otherwise(opaque)
    }


def has_userinfo(c: Getter) -> Column:
    return c("_userinfo").isNotNull() & ~c("_userinfo").isin("", ":")


def plain(url: Column, schemes: tuple[str, ...]) -> Column:
    """Lower-case scheme and dotted name, optional port: nothing but the scheme to refuse."""
    shape = (
        rf"^(?:{'|'.join(schemes)})://(?:[a-z0-9-]+\.)+[a-z][a-z0-9-]*"
        r"(?::[0-9]{1,4})?(?:[/?#][!-~]*)?\z"
    )
    suffixes = "|".join(s.lstrip(".").replace(".", r"\.") for s in PRIVATE_SUFFIXES)
    return url.rlike(shape) & ~url.rlike(rf"\.(?:{suffixes})(?:[:/?#]|\z)")


def private_name(host: Column) -> Column:
    name = F.regexp_replace(host, r"\.+\z", "")
    found = name.isin(*PRIVATE_NAMES)
    for suffix in PRIVATE_SUFFIXES:
        found = found | name.endswith(suffix)
    return found


def v4_kind(host: Column) -> Column:
    """Dotted, shortened, octal and hexadecimal IPv4 forms."""

    def number(part: Column) -> Column:
        def digits(text: Column, base: int, width: int) -> Column:
            bare = F.regexp_replace(text, "^0+", "")
            return F.when(F.length(bare) > width, F.lit(_TOO_BIG)).otherwise(
                F.conv(F.concat(F.lit("0"), bare), base, 10).cast("bigint")
            )

        return (
            F.when(part.rlike(r"^0x[0-9a-f]*\z"), digits(F.substring(part, 3, 1 << 20), 16, 8))
            .when(part.rlike(r"^0[0-7]+\z"), digits(part, 8, 11))
            .when(part.rlike(r"^(?:0|[1-9][0-9]*)\z"), digits(part, 10, 10))
        )

    def judge(numbers: Column) -> Column:
        count = F.size(numbers)
        lead = F.slice(numbers, F.lit(1), count - 1)
        last = F.get(numbers, count - 1)
        valid = (
            (count <= 4)
            & F.forall(numbers, lambda n: n.isNotNull())
            & F.forall(lead, lambda n: n <= 255)
            & (last < F.pow(F.lit(256.0), 5 - count))
        )
        head = F.aggregate(
            lead, F.lit(0).cast("bigint"), lambda total, n: (total * 256 + n).cast("bigint")
        )
        scale = F.pow(F.lit(256.0), 5 - count).cast("bigint")
        return F.when(~valid | valid.isNull(), MALFORMED).otherwise(
            F.when(private_v4(head * scale + last), PRIVATE).otherwise(PUBLIC)
        )

    parts = F.split(F.regexp_replace(host, r"\.\z", ""), r"\.", -1)
    return bind(F.transform(parts, number), judge)


def v6_kind(host: Column) -> Column:
    """Bracketed IPv6 address, with or without a dotted IPv4 tail."""
    inner = F.regexp_extract(host, r"(?s)^\[(.*)\]\z", 1)

    def pair(i: int) -> Column:
        high = F.regexp_extract(inner, _V4_TAIL, i).try_cast("int")
        low = F.regexp_extract(inner, _V4_TAIL, i + 1).try_cast("int")
        return F.when((high <= 255) & (low <= 255), F.lower(F.hex(high * 256 + low)))

    flat = F.when(
        inner.contains("."),
        F.concat(F.regexp_extract(inner, _V4_TAIL, 1), pair(2), F.lit(":"), pair(4)),
    ).otherwise(inner)

    def groups(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(
            F.split(half, ":", -1)
        )

    def expand(halves: Column) -> Column:
        left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
        zeros = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
        return F.when((F.size(halves) == 1) & (F.size(left) == 8), left).when(
            (F.size(halves) == 2) & (F.size(left) + F.size(right) <= 7),
            F.concat(left, zeros, right),
        )

    def judge(words: Column) -> Column:
        ok = words.isNotNull() & F.forall(words, lambda w: w.rlike(r"^[0-9a-f]{1,4}\z"))

        def ranges(n: Column) -> Column:
            def at(i: int) -> Column:
                return F.get(n, F.lit(i))

            zero5 = F.forall(F.slice(n, 1, 5), lambda x: x == 0)
            tail = at(6) * 65536 + at(7)
            embedded = zero5 & at(5).isin(0, 0xFFFF)
            loopback = zero5 & (at(5) == 0) & (tail <= 1)
            return F.when(
                (embedded & private_v4(tail)) | loopback | _between(at(0), PRIVATE_V6), PRIVATE
            ).otherwise(PUBLIC)

        numbers = F.transform(words, lambda w: F.conv(w, 16, 10).cast("bigint"))
        return F.when(ok, bind(numbers, ranges)).otherwise(MALFORMED)

    return bind(F.split(flat, "::", -1), lambda halves: bind(expand(halves), judge))


STAGES = (
    split_stage,
    scheme_stage,
    authority_stage,
    host_port_stage,
    host_stage,
    host_kind_stage,
)
