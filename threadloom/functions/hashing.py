"""Digests over length-framed fields, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_endian(n: Column, width: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def framed(field: Column) -> Column:
    """A field after its length in 8 bytes, so that fields can't run into each other."""
    raw = field.cast("binary")
    return F.concat(big_endian(F.octet_length(raw)), raw)


def framed_sha256(*fields: Column) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def content_hash(recipe, version, host, repo_id, thread_id, number, title, text, domain: str = "discussion-document-v1") -> Column:
    return framed_sha256(F.lit(domain), recipe, big_endian(version, 4), host, repo_id, thread_id, big_endian(number), title, text)


def chunk_hash(index: Column, text: Column, domain: str = "embedding-chunk-v1") -> Column:
    return framed_sha256(F.lit(domain), big_endian(index, 4), text)


def members_key(ids: Column, domain: str = "cluster-members-v1") -> Column:
    """The stable key of a cluster: the domain, a NUL and the sorted ids, 8 bytes each."""
    body = F.array_join(F.transform(F.array_sort(ids), lambda i: F.lpad(F.hex(i), 16, "0")), "")
    return F.concat(F.lit("members-"), F.sha2(F.concat(F.lit(domain).cast("binary"), F.unhex(F.lit("00")), F.unhex(body)), 256))


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")
