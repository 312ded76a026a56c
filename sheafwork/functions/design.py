"""Design tokens of pages and style sheets: colours and fonts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, strip
from .urls import decoded

#: How colours and fonts are written.
HEX = r"#[0-9a-fA-F]{8}\b|#[0-9a-fA-F]{6}\b|#[0-9a-fA-F]{3}\b"
RGB = r"(?i)rgba?\(\s*([\d.]+)[\s,]+([\d.]+)[\s,]+([\d.]+)"
HSL = r"(?i)hsla?\(\s*([\d.]+)(?:deg)?[\s,]+([\d.]+)%[\s,]+([\d.]+)%"
FAMILY = r"(?i)font-family\s*:\s*([^;{}]+)"
WEB_FONTS = r"""(?i)fonts\.googleapis\.com/css2?\?([^"'> )]+)"""
#: Names that are no font.
GENERIC_FONTS = (
    "inherit", "initial", "unset", "serif", "sans-serif", "monospace",
    "cursive", "fantasy", "system-ui", "ui-sans-serif", "ui-serif",
    "ui-monospace", "-apple-system", "blinkmacsystemfont",
)
MAX_COLORS, MAX_FONTS = 12, 20


def _hex(*channels: Column) -> Column:
    """#rrggbb of numbers: rounded half to even, held within 0 and 255."""
    whole = [F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c, 0).cast("int"))) for c in channels]
    return F.format_string("#%02x%02x%02x", *whole)


def _numbers(match: Column, pattern: str) -> list[Column]:
    return [F.regexp_extract(match, pattern, k).try_cast("double") for k in (1, 2, 3)]


def _from_hsl(h: Column, s: Column, light: Column) -> Column:
    s, light = s / 100, light / 100
    c = (1 - F.abs(2 * light - 1)) * s
    sector = F.pmod(h, F.lit(360.0)) / 60
    x = c * (1 - F.abs(F.pmod(sector, F.lit(2.0)) - 1))
    zero, m = F.lit(0.0), light - c / 2
    rgb = [F.when(sector < 1, F.array(c, x, zero)).when(sector < 2, F.array(x, c, zero)).when(sector < 3, F.array(zero, c, x)).when(sector < 4, F.array(zero, x, c)).when(sector < 5, F.array(x, zero, c)).otherwise(F.array(c, zero, x))]
    return let(rgb[0], lambda v: _hex(*((v[k] + m) * 255 for k in range(3))))


def colors(text: Column) -> Column:
    """array<string> of every colour as #rrggbb, hex notations first, then rgb
    and hsl; numbers that do not parse are left out."""
    text = F.coalesce(text, F.lit(""))

    def from_hex(m: Column) -> Column:
        short = F.concat(F.lit("#"), *(F.repeat(F.substring(m, k, 1), 2) for k in (2, 3, 4)))
        return F.lower(F.when(F.length(m) == 4, short).otherwise(F.substring(m, 1, 7)))

    def by(pattern: str, of) -> Column:
        matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.array(*_numbers(m, pattern)))
        real = F.filter(matches, lambda n: ~F.exists(n, lambda x: x.isNull()))
        return F.transform(real, lambda n: of(n[0], n[1], n[2]))

    return F.concat(F.transform(F.regexp_extract_all(text, F.lit(HEX), F.lit(0)), from_hex), by(RGB, _hex), by(HSL, _from_hsl))


def declared_fonts(text: Column) -> Column:
    """The first family of each declaration, unquoted, generic names left out."""
    unquoted = lambda c: F.regexp_replace(strip(c), r"""^['"]+|['"]+$""", "")
    declared = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FAMILY), F.lit(1)), lambda m: unquoted(F.substring_index(m, ",", 1)))
    return F.filter(declared, lambda f: (f != "") & ~F.lower(f).isin(*GENERIC_FONTS) & ~f.startswith("$") & ~f.startswith("--") & ~F.contains(F.lower(f), F.lit("var(")))


def web_fonts(page: Column) -> Column:
    """Names in a page's links to web fonts."""
    linked = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(WEB_FONTS), F.lit(1)), lambda q: F.regexp_extract_all(q, F.lit("family=([^&:]+)"), F.lit(1))))
    return F.filter(F.transform(linked, lambda f: strip(F.substring_index(decoded(f), ":", 1))), lambda f: f != "")


def fonts(blobs: Column, page: Column) -> Column:
    """The fonts that the blobs declare (the page, then its style sheets), then
    the page's web fonts: distinct, in order, 20 at most."""
    return first_fonts(F.flatten(F.transform(blobs, declared_fonts)), web_fonts(page))


def first_fonts(declared: Column, linked: Column) -> Column:
    return F.slice(F.array_distinct(F.concat(declared, linked)), 1, MAX_FONTS)
