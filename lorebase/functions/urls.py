"""URL handling as Column expressions over one generic-syntax pattern (RFC 3986, appendix B)."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.arrow import arrow_function
from lorebase import fixed

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?((?:[^?#]*/)?[^?#;/]*)(;[^?#/]*)?(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def _assemble(scheme_: Column, netloc_: Column, path_: Column, params: Column, query: Column, fragment: Column | None = None) -> Column:
    parts = [
        F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""),
        F.when(netloc_ != "", F.concat(F.lit("//"), netloc_)).otherwise(""),
        path_,
        params,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    ]
    if fragment is not None:
        parts.append(F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.concat(*parts)


def normalize(url: Column) -> Column:
    """No fragment, no trailing slash of the path, empty path as ``/``; the query stays."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    kept = F.when(trimmed == "", "/").otherwise(trimmed)
    return _assemble(scheme(url), netloc(url), kept, _part(url, 4), _part(url, 5))


def same_domain(base: Column, url: Column) -> Column:
    return netloc(base) == netloc(url)


def skipped_file(url: Column) -> Column:
    endings = "|".join(fixed.SKIP_EXTENSIONS)
    return F.lower(path(url)).rlike(rf"\.({endings})$")


def website_collection(url: Column) -> Column:
    return F.concat(F.replace(netloc(url), F.lit(":"), F.lit("-")), F.lit("-knowledge"))


def question_collection(body_id: Column) -> Column:
    return F.when(F.coalesce(body_id, F.lit("")) != "", F.concat(body_id, F.lit("-knowledge"))).otherwise("default-knowledge")


def tree_collection(body_id: Column, purpose: Column) -> Column:
    return F.concat(body_id, F.lit("-"), purpose)


def rewrite_internal(url: Column, base: Column, platform_domain: str) -> Column:
    """Point internal API addresses at the configured host; external ones stay.

    Internal are relative addresses, those of the host itself and those of hosts whose
    name ends with the platform's domain.
    """
    host = netloc(url)
    known = (host == "") | (host == netloc(base)) | host.endswith(platform_domain)
    internal = F.lit(False)
    for prefix in fixed.INTERNAL_PATHS:
        internal = internal | path(url).startswith(prefix)
    base_scheme = F.when(scheme(base) == "", "http").otherwise(scheme(base))
    moved = _assemble(base_scheme, netloc(base), path(url), _part(url, 4), _part(url, 5), _part(url, 6))
    return F.when((url != "") & known & internal, moved).otherwise(url)


def _resolved(page: str | None, link: str | None) -> str | None:
    if page is None or link is None:
        return None
    try:
        return urljoin(page, link)
    except ValueError:
        return None


@arrow_function(T.StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """Relative reference against the page address, dot segments included."""
    return pd.Series([_resolved(b, h) for b, h in zip(base, href)], dtype="object")


@arrow_function(T.ArrayType(T.StringType()))
def resolve_all(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    """:func:`resolve` for all references of a page."""
    found = [None if links is None else [_resolved(page, link) for link in links] for page, links in zip(base, hrefs)]
    return pd.Series(found, dtype="object")


@arrow_function(T.BooleanType())
def is_safe(urls: pd.Series) -> pd.Series:
    """http(s) only and no private, loopback, link-local or reserved address literal.

    Host names are not resolved: executors of a batch job do no DNS. Names therefore
    pass, and a live fetcher has to check the resolved address itself.
    """

    def one(url: str | None) -> bool:
        if not url:
            return False
        try:
            parts = urlsplit(url)
            host = parts.hostname
        except ValueError:
            return False
        if parts.scheme not in ("http", "https") or not host:
            return False
        try:
            address = ipaddress.ip_address(host)
        except ValueError:
            return True
        return not (address.is_private or address.is_loopback or address.is_link_local or address.is_reserved)

    return urls.map(one).astype(bool)
