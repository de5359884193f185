"""Clocks, hosts, selectors and links."""

from __future__ import annotations

import ipaddress
import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(c: Column) -> Column:
    """Microseconds of an RFC 3339 text, digits below truncated toward the epoch; null when it is none."""
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    rest = F.regexp_extract(c, r"\.\d{6}(\d+)", 1)
    short = F.regexp_replace(c, r"(\.\d{6})\d+", "$1")
    whole = F.unix_micros(F.try_to_timestamp(short))
    return F.when(shape, F.when((whole < 0) & rest.rlike("[1-9]"), whole + 1).otherwise(whole))


def rfc3339(us: int) -> str:
    at = datetime.fromtimestamp(us // 1_000_000, timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{us % 1_000_000:06d}" if us % 1_000_000 else "") + "Z"


def source_clock(raw: Column) -> Column:
    """struct(state, raw, us): missing, valid or invalid; the text of an invalid clock is kept."""
    us = micros(raw)
    state = F.when(raw.isNull(), "missing").when(us.isNotNull(), "valid").otherwise("invalid")
    return F.struct(state.alias("state"), F.when(state == "invalid", raw).alias("raw"), us.alias("us"))


def overlap_start(watermark_us: Column) -> Column:
    """Where the next scan begins: a day before the watermark, not below the smallest time."""
    least = -(1 << 63)
    return F.when(watermark_us < least + DAY_US, F.lit(least)).otherwise(watermark_us - DAY_US)


def parse_host(text: str) -> str:
    """Lower case, without port 443 and trailing dot; IPv6 in canonical form. Raises on anything but an authority."""
    m = re.fullmatch(r"(\[[0-9A-Fa-f:.]+\]|[^\s:/@\[\]?#]+)(?::(\d{1,5}))?", text)
    if not m:
        raise ValueError(f"not a host: {text!r}")
    name, port = m[1].lower(), m[2]
    if name[0] == "[":
        name = f"[{ipaddress.IPv6Address(name[1:-1]).compressed}]"
    else:
        name = name[:-1] if name.endswith(".") else name
        if not all(re.fullmatch(r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?", x) for x in name.split(".")):
            raise ValueError(f"not a host: {text!r}")
    if port and not 0 < int(port) < 65536:
        raise ValueError(f"not a port: {text!r}")
    return name if port in (None, "443") else f"{name}:{int(port)}"


def host(c: Column) -> Column:
    """parse_host() of a column of authorities, a batch at a time; null for what is none."""

    @F.arrow_udf("string")
    def parsed(values):
        import pyarrow as pa

        known: dict[str | None, str | None] = {None: None}
        for v in set(values.to_pylist()) - {None}:
            try:
                known[v] = parse_host(v)
            except ValueError:
                known[v] = None
        return pa.array([known[v] for v in values.to_pylist()], pa.string())

    return parsed(c)


#: A segment of a path: no white space, control character or mark of an address.
_SEGMENT = r"[^\s\p{Cntrl}/#?@\\]+"
_HTTPS = r"(?i)^https://([^/]*)/"


def _address(c: Column) -> tuple[Column, Column, Column]:
    """Whether a selector is an address, its host in canonical form, and its path without query, fragment and last slashes."""
    is_address = c.contains("://")
    path = F.regexp_replace(F.regexp_extract(c, _HTTPS + "([^?#]*)", 2), "/+$", "")
    return is_address, host(F.when(is_address, F.nullif(F.regexp_extract(c, _HTTPS, 1), F.lit("")))), path


def _found(pattern: str, text: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?U){pattern}", group), F.lit(""))


def parse_repository(c: Column, default_host: str | None = None) -> Column:
    """struct(host, owner, name) of owner/name, which is on the default host, or of an https address; all null when it is neither."""
    is_address, at, path = _address(c)
    both = rf"^({_SEGMENT})/({_SEGMENT})$"
    text = F.when(is_address, path).otherwise(c)
    ok = text.rlike(f"(?U){both}") & (~is_address | at.isNotNull())
    return F.struct(F.when(ok, F.when(is_address, at).otherwise(F.lit(default_host))).alias("host"), F.when(ok, _found(both, text, 1)).alias("owner"), F.when(ok, _found(both, text, 2)).alias("name"))


def parse_thread(c: Column, default_host: str | None = None) -> Column:
    """struct(host, owner, name, kind, number) of owner/name#N or of an issues or pull address; all null when it is neither.

    kind is what an address says, issues or pull. Numbers are above 0 and fit 64 bits with a sign.
    """
    is_address, at, path = _address(c)
    short, address = rf"^({_SEGMENT})/({_SEGMENT})#\+?([0-9]+)$", rf"^({_SEGMENT})/({_SEGMENT})/(issues|pull)/\+?([0-9]+)$"
    pick = lambda i, j: F.when(is_address, _found(address, path, j)).otherwise(_found(short, c, i))
    number = pick(3, 4).try_cast("bigint")
    ok = (number > 0) & (~is_address | at.isNotNull())
    keep = lambda x, name: F.when(ok, x).alias(name)
    return F.struct(keep(F.when(is_address, at).otherwise(F.lit(default_host)), "host"), keep(pick(1, 1), "owner"), keep(pick(2, 2), "name"), keep(F.when(is_address, _found(address, path, 3)), "kind"), keep(number, "number"))


def next_link(c: Column) -> Column:
    """The address of rel="next" in a Link header; null without one."""
    return F.nullif(F.regexp_extract(c, r"""<([^>]*)>\s*(?:;[^,]*?)?;\s*rel="?(?:[^",]*\s)?next(?:\s[^",]*)?"?""", 1), F.lit(""))


def failure_kind(status: Column) -> Column:
    """The kind of a provider failure from its HTTP status."""
    return (
        F.when(status.isin(401), "authentication").when(status.isin(403), "permission").when(status.isin(404, 410), "not_found")
        .when(status.isin(429), "rate_limited").when(status >= 500, "provider_unavailable").otherwise("provider_response")
    )


def backoff_ms(attempt: int, first: int = 250, most: int = 10_000) -> int:
    return min(most, first << min(attempt, 30))
