"""Assets of pages: fonts of style sheets, palettes, download plans, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.design import MAX_COLORS, colors, declared_fonts, first_fonts, web_fonts
from ..functions.html import KINDS, asset_hrefs, theme_color, title
from ..functions.urls import file_name, resolved
from .streams import fold_sorted

MAX_SHEETS = 20
MAX_ASSETS = 60
MAX_BYTES = 50 * 1024 * 1024
#: The order in which kinds are downloaded.
PLAN_ORDER = ("images", "icons", "svg", "css", "fonts", "scripts")


def sheet_hrefs(css: Column) -> Column:
    """The url()s of @font-face blocks as written."""
    blocks = F.regexp_extract_all(css, F.lit(r"(?i)@font-face\s*\{[^}]*\}"), F.lit(0))
    return F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?i)url\(([^)]+)\)"), F.lit(1))))


def sheet_fonts(sheets: DataFrame) -> DataFrame:
    """(css_url, ord, url): every url() of each @font-face block, absolute.
    Done once for each sheet, however many pages share it."""
    rows = sheets.select("css_url", F.posexplode(sheet_hrefs(F.col("css"))).alias("ord", "href"))
    return rows.select("css_url", "ord", resolved(F.col("css_url"), F.col("href")).alias("url")).where("url is not null")


def pattern_assets(pages: DataFrame) -> DataFrame:
    """(page_id, kind, ord, url): assets of pages (page_id, url, html) that patterns
    find, absolute, unique by kind in the order in which they are found."""
    found = pages.select("page_id", "url", F.posexplode(asset_hrefs(F.col("html"))).alias("at", "a"))
    urls = found.select("page_id", F.col("a.kind").alias("kind"), "at", resolved(F.col("url"), F.col("a.href")).alias("url")).where("url is not null")
    first = urls.groupBy("page_id", "kind", "url").agg(F.min("at").alias("at"))
    place = Window.partitionBy("page_id", "kind").orderBy("at")
    return first.select("page_id", "kind", (F.row_number().over(place) - 1).alias("ord"), "url")


def page_fonts(assets: DataFrame, sheets: DataFrame) -> DataFrame:
    """The assets and the fonts of each page's first 20 style sheets, new ones
    after those the page names.  ``assets`` has (page_id, kind, ord, url)."""
    linked = assets.where((F.col("kind") == "css") & (F.col("ord") < MAX_SHEETS)).select("page_id", F.col("ord").alias("sheet"), F.col("url").alias("css_url"))
    more = linked.join(sheet_fonts(sheets), "css_url").select("page_id", F.lit("fonts").alias("kind"), F.struct(F.lit(1).alias("a"), F.col("sheet").alias("b"), F.col("ord").alias("c")).alias("ord"), "url")
    own = assets.select("page_id", "kind", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("ord").alias("c")).alias("ord"), "url")
    every = own.unionByName(more).groupBy("page_id", "kind", "url").agg(F.min("ord").alias("ord"))
    place = Window.partitionBy("page_id", "kind").orderBy("ord")
    return every.select("page_id", "kind", (F.row_number().over(place) - 1).alias("ord"), "url")


def palette(pages: DataFrame, found: Column | None = None) -> DataFrame:
    """(page_id, rank, hex, n): the 12 commonest colours of a page; of equals the
    first seen.  ``found`` are its colours in order, by default those of its
    ``blobs`` (its HTML, then its sheets)."""
    found = F.flatten(F.transform("blobs", colors)) if found is None else found
    rows = pages.select("page_id", F.posexplode(found).alias("at", "hex"))
    counted = rows.groupBy("page_id", "hex").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    best = Window.partitionBy("page_id").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MAX_COLORS).select("page_id", "rank", "hex", "n")


def design(pages: DataFrame, assets: DataFrame, sheets: DataFrame) -> DataFrame:
    """(page_id, colors, fonts): what pages (page_id, html) and the first 20 of
    their style sheets name, in order.

    A sheet is read once, however many pages link to it, and neither it nor a page
    is shuffled: only the names meet.  A sheet that is not there is left out.
    """
    html, css = F.col("html"), F.col("css")
    own = pages.select("page_id", colors(html).alias("c"), declared_fonts(html).alias("f"), web_fonts(html).alias("w"))
    each = sheets.select("css_url", colors(css).alias("c"), declared_fonts(css).alias("f"))
    linked = assets.where((F.col("kind") == "css") & (F.col("ord") < MAX_SHEETS)).select("page_id", F.col("ord").alias("sheet"), F.col("url").alias("css_url"))
    more = linked.join(each, "css_url").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("sheet", "c", "f"))).alias("s"))
    of = lambda k: F.flatten(F.concat(F.array(k), F.coalesce(F.transform("s", lambda x: x[k]), F.array().cast("array<array<string>>"))))
    return own.join(more, "page_id", "left").select("page_id", of("c").alias("colors"), first_fonts(of("f"), F.col("w")).alias("fonts"))


def wanted_kinds(listed: Column, scripts: Column) -> Column:
    """array<string> of a comma list of kinds, with scripts if asked for."""
    own = F.filter(F.transform(F.split(listed, ","), lambda k: F.lower(F.trim(k))), lambda k: k != "")
    return F.array_distinct(F.when(scripts, F.concat(own, F.array(F.lit("scripts")))).otherwise(own))


def _plan_place() -> Column:
    return F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for n, k in enumerate(PLAN_ORDER)), F.lit(len(PLAN_ORDER)))


def _planner(max_assets: int, max_bytes: int):
    def begin():
        n = total = 0

        def step(row: dict) -> dict | None:
            nonlocal n, total
            if n >= max_assets:
                return None
            size = row["bytes"] or 0
            fits = total + size <= max_bytes
            if row["ok"] and fits:
                n, total = n + 1, total + size
                return {**row, "error": None}
            return {**row, "bytes": None, "error": "size-cap" if row["ok"] else row["error"] or "failed", "ok": False}

        return step

    return begin


def download_plan(fetches: DataFrame, *, kinds: tuple[str, ...] = KINDS[:5], max_assets: int = MAX_ASSETS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """What a page's download would take, in order of kind and place: the columns
    of ``fetches`` (page_id, kind, ord, url, ok, bytes, error and any others).

    A URL counts once; after ``max_assets`` are taken nothing more is looked
    at; one that would pass ``max_bytes`` is refused and the next one is tried.
    Which one is refused hangs on all before it, so each page's rows are gone
    through in order, as a stream: the state is two numbers.
    """
    rows = fetches.where(F.col("kind").isin(*kinds)).withColumn("_place", _plan_place())
    first = F.struct("_place", "ord", "kind", "ok", "bytes", "error")
    once = rows.groupBy("page_id", "url").agg(F.min_by(F.struct(*rows.columns), first).alias("r")).select("r.*")
    types = fetches.select(*(F.col(c).cast("boolean" if c == "ok" else "bigint" if c == "bytes" else t).alias(c) for c, t in fetches.dtypes)).schema
    return fold_sorted(once.withColumn("bytes", F.col("bytes").cast("bigint")), ["page_id"], ["_place", "ord"], _planner(max_assets, max_bytes), types)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _namer():
    """A folder's names in order: what is taken, and for each name the number
    from which a free one is looked for; lower ones stay taken."""
    taken, numbers = set(), {}

    def step(row: dict) -> dict:
        path = row["name"]
        if path in taken:
            stem, k = row["stem"], numbers.get(path, 1)
            while (path := f"{stem}-{k}{row['name'][len(stem) :]}") in taken:
                k += 1
            numbers[row["name"]] = k + 1
        taken.add(path)
        return {**{c: row[c] for c in ("page_id", "kind", "ord", "url", "name")}, "path": path}

    return step


def unique_names(named: DataFrame) -> DataFrame:
    """``name`` made unique within (page_id, kind): the second and later ones
    get -1, -2, ... before the suffix, passing over names that are there.

    A repeat's number is its place among those of its name.  Only folders where
    a name so made is there already are gone through in order, as a stream.
    """
    again = F.row_number().over(Window.partitionBy("page_id", "kind", "name").orderBy("ord", "url"))
    numbered = named.select("page_id", "kind", F.col("ord").cast("int").alias("ord"), "url", "name", again.alias("k"), _stem(F.col("name")).alias("stem"))
    made = F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat("stem", F.lit("-"), F.col("k") - 1, F.substring("name", F.length("stem") + 1, F.length("name"))))
    numbered = numbered.select("page_id", "kind", "ord", "url", "name", made.alias("path"), "stem")
    twice = numbered.groupBy("page_id", "kind", "path").count().where("count > 1").select("page_id", "kind").distinct()
    clear = numbered.join(twice, ["page_id", "kind"], "left_anti").drop("stem")
    clashing = numbered.join(twice, ["page_id", "kind"], "left_semi").drop("path")
    return clear.unionByName(fold_sorted(clashing, ["page_id", "kind"], ["ord", "url"], _namer, clear.schema))


def answered(assets: DataFrame, responses: DataFrame) -> DataFrame:
    """``assets`` with what came when they were fetched: ok, bytes, error,
    content_type, final_url, backend.  ``responses`` has a row for each URL."""
    own = assets.join(responses, "url", "left").withColumn("error", F.when(F.col("ok").isNull(), F.lit("not fetched")).otherwise(F.col("error")))
    return own.select("page_id", "kind", "ord", "url", F.coalesce("ok", F.lit(False)).alias("ok"), "bytes", "error", "content_type", "final_url", "backend")


def manifests(pages: DataFrame, tokens: DataFrame, assets: DataFrame, plan: DataFrame) -> DataFrame:
    """A row per page: page_id, url, title, page_backend, theme_color, palette,
    fonts, found (a count for every kind), downloaded, assets, page_md.

    ``pages`` has (page_id, url, html, backend) and ``markdown`` where the page was
    read too; ``tokens`` are of :func:`design`; ``plan`` is a download plan over
    :func:`answered` assets.  Taken ones get a local path, kind and unique file
    name; the others their error.  Everything meets by page, each frame grouped
    by page once, so that the last joins shuffle nothing, and no HTML moves.
    """
    names = plan.where("ok").select("page_id", "kind", "ord", "url", file_name(F.coalesce("final_url", "url"), F.col("content_type"), F.lit(None).cast("string")).alias("name"))
    paths = unique_names(names).select("page_id", "kind", "url", F.concat_ws("/", "kind", "path").alias("local_path"))
    placed = plan.join(paths, ["page_id", "kind", "url"], "left")
    order = F.struct(_plan_place().alias("place"), "ord")
    record = F.struct(F.col("url").alias("source_url"), "kind", "ok", "local_path", "bytes", F.when(F.col("ok"), F.col("content_type")).alias("content_type"), F.when(F.col("ok"), F.col("backend")).alias("backend"), "error")
    records = placed.groupBy("page_id").agg(F.count_if("ok").alias("downloaded"), F.array_sort(F.collect_list(F.struct(order.alias("order"), record.alias("r")))).alias("rs"))
    records = records.select("page_id", "downloaded", F.transform("rs", lambda r: r["r"]).alias("assets"))
    counts = assets.groupBy("page_id").agg(F.map_from_entries(F.array(*(F.struct(F.lit(k), F.count_if(F.col("kind") == k)) for k in KINDS))).alias("found"))
    colours = palette(tokens, F.col("colors")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hex", "n"))).alias("ps"))
    colours = colours.select("page_id", F.transform("ps", lambda p: F.struct(p["hex"].alias("hex"), p["n"].alias("count"))).alias("palette"))
    read = F.when(F.col("markdown").isNotNull(), F.lit("page.md")) if "markdown" in pages.columns else F.lit(None).cast("string")
    heads = pages.select("page_id", "url", title(F.col("html")).alias("title"), F.col("backend").alias("page_backend"), theme_color(F.col("html")).alias("theme_color"), read.alias("page_md"))
    joined = heads.join(counts, "page_id", "left").join(records, "page_id", "left").join(colours, "page_id", "left").join(tokens.select("page_id", "fonts"), "page_id", "left")
    none = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(0).cast("long")) for k in KINDS)))
    return joined.select(
        "page_id", "url", "title", "page_backend", "theme_color", F.coalesce("palette", F.array().cast(colours.schema["palette"].dataType)).alias("palette"), "fonts",
        F.coalesce("found", none).alias("found"), F.coalesce("downloaded", F.lit(0).cast("long")).alias("downloaded"), F.coalesce("assets", F.array().cast(records.schema["assets"].dataType)).alias("assets"), "page_md",
    )
