"""Classification of stored responses."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

#: Text of pages that stand in front of the real one.
BLOCK_PHRASES = (
    "just a moment...",
    "enable javascript and cookies to continue",
    "checking your browser before accessing",
    "attention required! | cloudflare",
    "/cdn-cgi/challenge-platform",
    "_cf_chl_opt",
    "press & hold",
    "access to this page has been denied",
    "verify you are human",
    "please verify you are a human",
    "request unsuccessful. incapsula incident",
    "captcha-delivery.com",
    "target url returned error",
    "awswafcookiedomainlist",
    "gokuprops",
    "pardon our interruption",
    "powered by incapsula",
    "please enable js and disable any ad blocker",
    "px-captcha",
    "oops! it appears something made us think you are a bot",
    "sucuri website firewall",
    "vercel security checkpoint",
    "needs to review the security of your connection before proceeding",
    "press and hold to verify that you are human",
    "queue-it.net",
    "perfdrive.com",
    "window.kpsdk",
    "reference #18.",
    "errors.edgesuite.net",
    "your request has been blocked as a possible bot",
    "checking if the site connection is secure",
    "complete the challenge below",
    "let us know you're a real person",
    "let us know you are a real person",
)
MIN_CHARS = 500
HEAD_CHARS = 8192
#: Content types whose bodies are looked at.
TEXTUAL_TYPES = ("text/html", "application/xhtml", "text/xml", "application/xml")
#: Least characters of a page by the way it was captured.
LEAST_BY_BACKEND = {"relay": 500, "browser": 8000}


def lower_headers(headers: Column) -> Column:
    """Header names in lower case; of names that meet, the later value stays."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    last = F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"])
    return F.map_from_arrays(names, last)


def has_block_phrase(text: Column) -> Column:
    """Is one of the phrases in the first characters?  Cut before lower-casing,
    which may lengthen; the head is made once for all phrases."""

    def found(head: Column) -> Column:
        return reduce(or_, (F.contains(head, F.lit(phrase)) for phrase in BLOCK_PHRASES))

    return let(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, HEAD_CHARS)), found)


def _header(headers: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))


def _stamps(headers: Column) -> dict[str, Column]:
    """Challenge stamps by header, for headers in lower case."""
    return {
        "cf-mitigated": _header(headers, "cf-mitigated") == "challenge",
        "x-datadome-ch": F.lower(_header(headers, "x-datadome-ch")).isin("blocked", "challenge"),
        "x-akamai-session-info": F.contains(F.lower(_header(headers, "x-akamai-session-info")), F.lit("challenge")),
    }


def block_reason(status: Column, text: Column, headers: Column | None = None) -> Column:
    """``no-response``, ``http-N``, ``challenge``, or null for a real page."""
    reason = F.when(status.isNull(), F.lit("no-response")).when(status >= 400, F.concat(F.lit("http-"), status.cast("string")))
    if headers is not None:
        a, b, c = _stamps(headers).values()
        reason = reason.when(a | b | c, F.lit("challenge"))
    return reason.when(has_block_phrase(text), F.lit("challenge"))


def drop_stale_stamps(headers: Column, body: Column) -> Column:
    """Without the first response's challenge stamps if the body is clean."""
    stamps = _stamps(headers)
    stale = lambda k: (k == "cf-mitigated") | ((k == "x-datadome-ch") & stamps["x-datadome-ch"]) | ((k == "x-akamai-session-info") & stamps["x-akamai-session-info"])
    return F.when(has_block_phrase(body), headers).otherwise(F.map_filter(headers, lambda k, v: ~stale(k)))


def is_thin(text: Column, allow_thin: Column | None = None, least: int = MIN_CHARS) -> Column:
    thin = F.length(F.coalesce(text, F.lit(""))) < least
    return thin if allow_thin is None else thin & ~F.coalesce(allow_thin, F.lit(False))


def thin_reason(size: Column) -> Column:
    return F.concat(F.lit("thin-"), size.cast("string"), F.lit("b"))


def rejected(backend: Column, status: Column, content_type: Column, body: Column) -> Column:
    """Why an asset or page response is not taken, or null: a status from 400,
    a challenge in a textual body (or one without type), an empty body, or a
    page that is too short for the way it was captured."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    textual = kind == ""
    for t in TEXTUAL_TYPES:
        textual = textual | F.contains(kind, F.lit(t))
    size = F.length(F.coalesce(body, F.lit("")))
    reason = F.when(status.isNull(), F.lit("no-response")).when(status >= 400, F.concat(F.lit("http-"), status.cast("string")))
    reason = reason.when(textual & has_block_phrase(body), F.lit("challenge")).when(size == 0, F.lit("empty"))
    for name, least in LEAST_BY_BACKEND.items():
        reason = reason.when((backend == name) & textual & (size < least), F.lit("thin"))
    return reason
