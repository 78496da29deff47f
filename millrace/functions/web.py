"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_rejection(url: Column, mode: Column, hosts: Column) -> Column:
    """null, "invalid_url" or "host".

    Only https passes.  ``mode`` is "any-https" (no credentials, no IP literal),
    "hosts" (the host must be in the array ``hosts``) or null (unknown source)."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    host = F.lower(part("HOST"))
    ip = host.contains(":") | host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")
    return (
        F.when(F.coalesce(F.lower(part("PROTOCOL")), F.lit("")) != "https", "invalid_url")
        .when(host.isNull(), "invalid_url")
        .when(mode.isNull(), "host")
        .when((mode == "any-https") & (part("USERINFO").isNotNull() | ip), "invalid_url")
        .when((mode != "any-https") & ~F.coalesce(F.array_contains(hosts, host), F.lit(False)), "host"))


def drop_query_keys(url: Column, keys: list[str]) -> Column:
    """A URL without the named query parameters."""
    pattern = "(?i)([?&])(?:" + "|".join(keys) + ")=[^&#]*"
    out = F.regexp_replace(url, pattern, "$1")
    out = F.regexp_replace(out, r"([?&])&+", "$1")
    return F.regexp_replace(out, r"[?&]+(#|$)", "$1")


def remote_type(location: Column, tags: Column, default: str) -> Column:
    """hybrid wins; on-site words without remote words; remote words; default."""
    text = F.lower(F.concat_ws(" ", location, tags))
    has = lambda *words: F.greatest(*[text.contains(w) for w in words])
    onsite = has("onsite", "on-site", "on site", "in office", "in-office")
    remote = has("remote", "work from home", "anywhere")
    return F.when(text.contains("hybrid"), "hybrid").when(onsite & ~remote, "onsite").when(remote, "remote").otherwise(default)
