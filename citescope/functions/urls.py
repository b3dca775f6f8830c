"""URL, domain and header expressions. All native: no UDF, no join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from .text import col, first_or_null, strip, text_or_empty

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:/+"
_AUTHORITY = rf"^{_SCHEME}(?:[^/?#\\@]*@)?(\[[^\]]*\]|[^/?#\\:]*)"
_BAD_HOST = r"[\s<>^|%\"{}`\x00-\x1f]"
# Host of a URL with or without scheme; no match if the host holds a forbidden character.
_HOST = (
    rf"^\s*(?:{_SCHEME})?+(?:[^/?#\\@]*@)?"
    r"(\[[^\]]*\]|[^/?#\\:@\s<>^|%\"{}`\x00-\x1f]+)(?=[/?#\\:]|\s*$)"
)


def _or_else(value: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), other)


def url_host(url: Column | str) -> Column:
    """Lower-case host; a missing scheme is added; text without a host comes back in lower case."""
    raw = col(url)
    return _or_else(F.lower(F.regexp_extract(raw, _HOST, 1)), F.lower(raw))


def domain_of_host(host: Column, suffixes: Sequence[str] = K.MULTI_LABEL_SUFFIXES) -> Column:
    """One label more than the public suffix; numeric hosts and single labels stay as they are."""
    known = "|".join(s.replace(".", r"\.") for s in suffixes)
    domain = F.regexp_extract(
        host, rf"^(?![0-9.]+$)(?:[^:]*?\.)??([^.:]+\.(?:{known}|[^.:]+))$", 1
    )
    return _or_else(domain, F.regexp_replace(host, r"^www\.", ""))


def registrable_domain(url: Column | str, suffixes: Sequence[str] = K.MULTI_LABEL_SUFFIXES) -> Column:
    """eTLD+1 of a URL or host, '' for empty input."""
    return F.coalesce(domain_of_host(url_host(url), suffixes), F.lit(""))


def unwrap_redirect(url: Column | str) -> Column:
    """The wrapped target of a known redirector link, else the link itself."""
    raw = col(url)
    values = F.array(
        *[
            F.try_url_decode(F.regexp_extract(raw, rf"^[^?#]*\?(?:[^#]*?&)??{name}=([^&#]*)", 1))
            for name in K.REDIRECT_PARAMS
        ]
    )
    target = first_or_null(F.filter(values, lambda v: v.rlike(r"(?i)^https?://")))
    return F.when(raw.rlike(_WRAPPER), F.coalesce(target, raw)).otherwise(raw)


_WRAPPER = (
    rf"(?i)^{_SCHEME}(?:[^/?#\\@]*@)?"
    rf"(?:{'|'.join(K.REDIRECT_HOSTS)})(?=[:/?#]|$)"
)


def same_site(cited: Column | str, target_domain: Column) -> Column:
    """A cited link belongs to the registrable domain of the target."""
    return (target_domain != "") & (registrable_domain(unwrap_redirect(cited)) == target_domain)


def is_platform(url: Column | str) -> Column:
    """Shared platform or aggregator, not a site of its own. The list is fixed, so no join."""
    return registrable_domain(url).isin(K.PLATFORM_DOMAINS)


def keep_platforms(df: DataFrame, url: str) -> DataFrame:
    return df.where(is_platform(url))


def drop_platforms(df: DataFrame, url: str) -> DataFrame:
    return df.where(~F.coalesce(is_platform(url), F.lit(False)))


def url_problem(url: Column | str) -> Column:
    """Why a URL may not be measured, NULL if it may."""
    raw = col(url)
    text = strip(text_or_empty(raw))
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*:/*([^/?#\\]*)", 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    host = F.regexp_replace(host_port, r":[^:\]]*$", "")
    port = F.regexp_extract(host_port, r":([^:\]]*)$", 1)
    web = scheme.isin("http", "https")
    return (
        F.when(text == "", "missing-url")
        .when(is_platform(text), "platform-url")
        .when(F.length(raw) > K.MAX_URL_LENGTH, "url-too-long")
        .when(scheme == "", "invalid-url")
        .when(web & ((host == "") | host.rlike(_BAD_HOST) | port.rlike(r"[^0-9]")), "invalid-url")
        .when(web & (F.coalesce(port.try_cast("bigint"), F.lit(0)) > 65535), "invalid-url")
        .when(~web, "bad-scheme")
        .when((port != "") & ~F.coalesce(port.try_cast("bigint"), F.lit(0)).isin(80, 443), "bad-port")
        .when(authority.contains("@") & ~authority.startswith("@"), "userinfo-not-allowed")
    )


def loose_host_match(link: Column | str, site: Column | str) -> Column:
    """Hosts without www. are equal, or one lies below the other."""
    raw = text_or_empty(link)
    full = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = F.regexp_replace(F.lower(F.regexp_extract(full, _AUTHORITY, 1)), r"^www\.", "")
    target = F.lower(F.regexp_replace(col(site), r"^www\.", ""))
    below = F.endswith(host, F.concat(F.lit("."), target)) | F.endswith(
        target, F.concat(F.lit("."), host)
    )
    return (raw != "") & (host != "") & (target != "") & ((host == target) | below)


def url_path(url: Column | str) -> Column:
    """Path without one trailing slash, '/' if empty, NULL if the URL has no host."""
    raw = col(url)
    path = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1)
    short = F.regexp_replace(path, r"/$", "")
    return F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.when(short == "", "/").otherwise(short))


def embeddable(headers: Column | str) -> Column:
    """May the page be framed by another origin, judged from its response headers?"""
    entries = F.map_entries(col(headers))

    def header(name: str) -> Column:
        hit = first_or_null(F.filter(entries, lambda e: F.lower(e["key"]) == name))
        return text_or_empty(hit["value"])

    policy = F.lower(header("content-security-policy"))
    ancestors = F.regexp_extract(policy, r"frame-ancestors([^;]*)", 1)
    closed = policy.contains("frame-ancestors") & (
        ~ancestors.contains("*") | ancestors.rlike("'none'|'self'")
    )
    return F.coalesce((strip(header("x-frame-options")) == "") & ~closed, F.lit(False))
