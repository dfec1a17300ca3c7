"""Web addresses: whose site they are on, and whether they may be asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: A longer address is no product page (fixed value).
MAX_URL_LENGTH = 500


def host(url: Column) -> Column:
    """The host, lower case, without credentials and port; empty where there is none."""
    place = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, "^.*@", ""), ":[^:\\]]*$", ""))


def _on_site(name: Column, domain: Column) -> Column:
    return bound(F.regexp_replace(name, r"^www\.", ""), lambda n: (n == domain) | n.endswith(F.concat(F.lit("."), domain)))


def same_site(url: Column, domain: Column) -> Column:
    """Whether the host is the domain or one under it; ``www.`` doesn't count. False for NULL."""
    return F.coalesce((domain != "") & _on_site(host(url), domain), F.lit(False))


def page_allowed(url: Column, domain: Column) -> Column:
    """An address of the domain by HTTPS: no white space, credentials, other ports, numeric or local hosts. False for NULL."""
    raw = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")

    def named(name: Column) -> Column:
        return name.contains(".") & ~name.endswith(".local") & ~name.rlike(r"^[0-9.]+$") & ~name.rlike(r"[\[\]]") & F.coalesce((domain != "") & _on_site(name, domain), F.lit(False))

    def allowed(raw: Column) -> Column:
        place = F.regexp_extract(raw, "^[Hh][Tt][Tt][Pp][Ss]://([^/?#]*)", 1)
        plain = (raw != "") & (F.length(raw) <= MAX_URL_LENGTH) & ~raw.rlike(r"[\s\p{Z}\x00-\x1f\x85]")
        return plain & bound(place, lambda p: (p != "") & ~p.contains("@") & p.rlike(r"^[^:]*(:(0*443)?)?$")) & bound(host(raw), named)

    return bound(raw, allowed)
