"""URL columns: canonical keys, domains, share links, file names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, strip

#: Query parameters that only track.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "ref", "ref_src",
    "igshid", "spm", "_ga", "yclid",
)
#: Public suffixes of two labels.
MULTI_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "co.jp", "co.kr", "co.in",
    "com.au", "com.br", "com.cn", "com.mx", "com.tr", "co.nz", "co.za",
)
#: Share links by provider; group 1 is the share's id.
SHARE_PATTERNS = {
    "chatgpt": r"^https?://(?:chatgpt\.com|chat\.openai\.com)/(?:share|s)/([A-Za-z0-9_-]+)",
    "claude": r"^https?://claude\.ai/share/([a-f0-9-]{36})",
    "copilot": r"^https?://copilot\.microsoft\.com/shares/(?:pages/)?([A-Za-z0-9_-]+)",
    "deepseek": r"^https?://chat\.deepseek\.com/share/([A-Za-z0-9]+)",
    "gemini": r"^https?://(?:gemini\.google\.com/share|g\.co/gemini/share)/([A-Za-z0-9]+)",
    "grok": r"^https?://(?:www\.)?(?:grok\.com/share|x\.com/i/grok/share)/([A-Za-z0-9._%=~-]+)",
    "perplexity": r"^https?://(?:www\.)?perplexity\.ai/(?:search|page)/([A-Za-z0-9._-]+)",
    "poe": r"^https?://(?:www\.)?poe\.com/s/([A-Za-z0-9]+)",
}
#: File extensions of media types.
EXTENSIONS = {
    "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp",
    "image/svg+xml": ".svg", "image/vnd.microsoft.icon": ".ico", "image/avif": ".avif",
    "text/css": ".css", "text/html": ".html", "text/javascript": ".js", "text/plain": ".txt",
    "application/javascript": ".js", "application/json": ".json", "application/pdf": ".pdf",
    "font/woff": ".woff", "font/woff2": ".woff2", "font/ttf": ".ttf", "font/otf": ".otf",
}

#: scheme, authority, path, query, fragment
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def with_scheme(url: Column) -> Column:
    """``https://`` before what has neither scheme (in lower case)."""
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    """Lower-case host without user, port and brackets; empty if there is none."""
    own = F.regexp_replace(_part(url, 2), "^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(own, r":\d*$", ""), r"^\[|\]$", ""))


def decoded(text: Column) -> Column:
    """Percent-decoded with plus as space; as it is where that fails."""
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def encoded(text: Column) -> Column:
    """Form encoding: space as plus, letters, digits and ``_.-~`` as they are."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """The key under which two spellings of a URL meet.

    Lower-case scheme (https by default) and host, no user, no default port, no
    tracking parameters, the others sorted and encoded anew, no fragment, no
    slashes at the path's end.  A port that is no number up to 65535 leaves the
    stripped input.  Null stays null.
    """

    def of(u: Column) -> Column:
        scheme = F.when(_part(u, 1) != "", F.lower(_part(u, 1))).otherwise(F.lit("https"))
        authority = F.regexp_replace(_part(u, 2), "^.*@", "")
        port_text = F.regexp_extract(authority, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
        port = port_text.try_cast("int")
        bad = (port_text != "") & (~port_text.rlike(r"^\d+$") | port.isNull() | (port > 65535))
        plain = ((scheme == "https") & (port == 443)) | ((scheme == "http") & (port == 80)) | (port == 0)
        full = F.when(port.isNull() | plain, host(u)).otherwise(F.concat(host(u), F.lit(":"), port.cast("string")))
        pairs = F.transform(
            F.filter(F.split(_part(u, 4), "&"), lambda p: p != ""),
            lambda p: F.struct(decoded(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")),
        )
        kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS)))
        query = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
        path = F.regexp_replace(_part(u, 3), "/+$", "")
        place = F.when(full != "", F.concat(F.lit("//"), full, F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path))).otherwise(path)
        key = F.concat(scheme, F.lit(":"), place, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
        return F.when(bad, u).otherwise(key)

    return let(strip(url), of)


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host, three under a suffix of two labels;
    empty if there is no host or it holds white space."""

    def of(h: Column) -> Column:
        labels = F.split(h, r"\.")
        two = F.array_join(F.slice(labels, -2, 2), ".")
        long = F.when(two.isin(*MULTI_SUFFIXES), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)
        return F.when((h == "") | h.rlike(r"(?U)\s"), F.lit("")).when(F.size(labels) <= 2, h).otherwise(long)

    return let(F.regexp_replace(host(with_scheme(url)), r"^\.+|\.+$", ""), of)


def share_link(url: Column, patterns: Mapping[str, str] = SHARE_PATTERNS) -> Column:
    """struct(provider, share_id) of a shared chat's link, else null.  The first
    pattern that matches decides; a grok id is percent-decoded."""
    out = F.lit(None).cast("struct<provider:string,share_id:string>")
    for provider, pattern in reversed(patterns.items()):
        own = F.regexp_extract(url, pattern, 1)
        if provider == "grok":
            own = F.coalesce(F.try_url_decode(F.replace(own, F.lit("+"), F.lit("%2B"))), own)
        out = F.when(url.rlike(pattern), F.struct(F.lit(provider).alias("provider"), own.alias("share_id"))).otherwise(out)
    return out


def host_folder(url: Column) -> Column:
    """The authority as a folder name, ``site`` if there is none."""
    own = F.replace(_part(url, 2), F.lit(":"), F.lit("_"))
    return F.when(own != "", own).otherwise(F.lit("site"))


def file_name(url: Column, content_type: Column, disposition: Column) -> Column:
    """A safe name for an asset: from its content disposition, else from the
    URL's last path segment, else from a hash of the URL; with an extension by
    media type if it has none; at most 120 characters."""
    # The patterns of a disposition's name and of characters that no file name holds.
    given = F.regexp_extract(F.coalesce(disposition, F.lit("")), r"""filename\*?=(?:[^']*'')?["']?([^"';]+)""", 1)
    given = F.coalesce(F.try_url_decode(F.replace(given, F.lit("+"), F.lit("%2B"))), given)
    path = _part(url, 3)
    raw = F.when(given != "", given).otherwise(F.regexp_extract(path, "([^/]*)$", 1))
    raw = strip(F.regexp_extract(raw, "^([^?#]*)", 1))
    safe = F.regexp_replace(F.regexp_replace(raw, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^\.+", "")
    named = F.when(safe != "", safe).otherwise(F.concat(F.lit("asset-"), F.substring(F.sha1(url), 1, 10)))
    kind = strip(F.regexp_extract(F.coalesce(content_type, F.lit("")), "^([^;]*)", 1))
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return let(named, lambda n: F.substring(F.when(F.contains(n, F.lit(".")), n).otherwise(F.concat(n, F.coalesce(F.try_element_at(table, kind), F.lit("")))), 1, 120))


def _without_dots(segments: Column) -> Column:
    """A path's segments with ``.`` and ``..`` worked off, by a fold."""

    def step(stack: Column, part: Column) -> Column:
        popped = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(part == "..", popped).when(part == ".", stack).otherwise(F.array_append(stack, part))

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(F.try_element_at(segments, F.lit(-1)).isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)


def _joined_path(base_path: Column, path: Column) -> Column:
    """A reference's path seen from a base's: beside its last segment, or from
    the root.  Empty segments within it go."""
    before = F.split(base_path, "/")
    folder = F.when(F.element_at(before, -1) != "", F.slice(before, 1, F.size(before) - 1)).otherwise(before)
    whole = F.when(F.startswith(path, F.lit("/")), F.split(path, "/")).otherwise(F.concat(folder, F.split(path, "/")))

    def tidy(parts: Column) -> Column:
        within = F.filter(parts, lambda x, k: (x != "") | (k == 0) | (k == F.size(parts) - 1))
        return F.array_join(_without_dots(within), "/")

    return let(let(whole, tidy), lambda p: F.when(p == "", F.lit("/")).when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p)))


def resolved(base: Column, href: Column) -> Column:
    """The absolute http(s) URL of a reference as a page writes it, else null.

    White space and quotes around it go, tabs and line breaks within it too.  A
    reference with another scheme than the base's stands as it is; one with the
    base's scheme and no authority is relative; an empty authority counts as
    none, and ``;`` is a character of a path like any other.  Null where the
    reference is null or empty, or where an authority has half a pair of brackets.
    """
    clean = lambda u: F.regexp_replace(F.coalesce(u, F.lit("")), r"[\t\r\n]", "")
    own = F.regexp_replace(strip(F.regexp_replace(strip(href), r"""^['"]+|['"]+$""", "")), r"[\t\r\n]", "")

    def of(s: Column) -> Column:
        b, u = s["b"], s["u"]
        b_scheme, scheme = F.lower(_part(b, 1)), F.lower(_part(u, 1))
        same = (scheme == "") | (scheme == b_scheme)
        query, fragment = (F.when(_part(u, n) != "", F.concat(F.lit(mark), _part(u, n))).otherwise(F.lit("")) for n, mark in ((4, "?"), (5, "#")))
        b_query = F.when(_part(b, 4) != "", F.concat(F.lit("?"), _part(b, 4))).otherwise(F.lit(""))
        path = _part(u, 3)
        rooted = lambda p: F.when((p == "") | F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))
        away = F.concat(b_scheme, F.lit("://"), _part(u, 2), rooted(path), query, fragment)
        here = F.concat(b_scheme, F.lit("://"), _part(b, 2))
        stays = F.concat(here, rooted(_part(b, 3)), F.when(query != "", query).otherwise(b_query), fragment)
        moved = F.concat(here, _joined_path(_part(b, 3), path), query, fragment)
        joined = F.when((b == "") | ~same, u).when(_part(u, 2) != "", away).when(path == "", stays).otherwise(moved)
        broken = lambda n: F.contains(n, F.lit("[")) != F.contains(n, F.lit("]"))
        return F.when((u != "") & ~broken(_part(u, 2)) & ~broken(_part(b, 2)) & joined.rlike("(?i)^https?://"), joined)

    return let(F.struct(clean(base).alias("b"), own.alias("u")), of)
