"""Operators on small examples of our own."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sheafwork.operators import assets, captions, capture, chats, fusion, scorecard
from sheafwork.sources import payloads, sinks
from sheafwork.streaming import landing


def rows(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


HITS = "query long, provider string, provider_ord int, rank int, title string, url string, snippet string, source string"


def test_fusion(spark):
    given = [
        (1, "a", 0, 0, "Long title", "https://e.com/x?utm_source=a", "s", "a"),
        (1, "a", 0, 1, "b", "https://e.com/y", "", "a"),
        (1, "b", 1, 0, "t", "https://E.com/x/", "longer", "b"),
        (1, "b", 1, 1, "", "https://e.com/z", None, ""),
        (1, "b", 1, 2, "t2", "https://e.com/x", "s", "b"),
    ]
    frame = spark.createDataFrame(given, HITS)
    got = fusion.fused(frame, 10).orderBy("rank").collect()
    assert [r["key"] for r in got] == ["https://e.com/x", "https://e.com/y", "https://e.com/z"]
    assert got[0]["score"] == 1 / 61 + 1 / 61 + 1 / 63
    assert (got[0]["title"], got[0]["snippet"], got[0]["url"], got[0]["source"]) == ("Long title", "longer", "https://e.com/x?utm_source=a", "a, b")
    assert [r["key"] for r in fusion.fused(frame.repartition(7), 1).collect()] == ["https://e.com/x"]
    assert fusion.fused(frame.limit(0)).count() == 0
    assert [fusion.clamp(n) for n in (None, 0, -3, 7, 99)] == [5, 5, 1, 7, 25]


def test_requests_and_outcomes(spark):
    one = spark.range(1)
    assert one.select(fusion.requested(F.lit(" A, b ,a,,C"))).first()[0] == ["a", "b", "c"]
    assert one.select(fusion.requested(F.lit(None).cast("string"))).first()[0] == ["ddg"]
    asked = spark.createDataFrame([(q, p, k) for q in (1, 2) for k, p in enumerate(("a", "b", "nope"))], "query long, provider string, provider_ord int")
    hits = spark.createDataFrame([(1, "a", 0, 0, "t", "u", "s", "a")], HITS)
    errors = spark.createDataFrame([(2, "b", "OSError: x")], "query long, provider string, error string")
    out = fusion.outcomes(asked, hits, errors, ("a", "b"))
    assert rows(out, "query", "provider_ord") == [(1, "a", 0, None), (1, "b", 1, "no-results"), (1, "nope", 2, "unknown-provider"), (2, "a", 0, "no-results"), (2, "b", 1, "OSError: x"), (2, "nope", 2, "unknown-provider")]
    assert rows(fusion.failures(out)) == [(2, "all search providers failed for '2' -> a: no-results; b: OSError: x; nope: unknown-provider")]


def test_payloads(spark):
    brave = json.dumps({"web": {"results": [{"title": " T ", "url": "u1", "description": "d"}, {"title": "x", "url": "  "}, {"url": "u3"}]}})
    ddg = json.dumps([{"title": "A", "link": "l", "snippet": "s"}, {"href": "h", "body": "", "snippet": "z"}])
    frame = spark.createDataFrame([(1, "brave", brave), (1, "ddg", ddg), (2, "exa", "not json"), (2, "other", "{}"), (3, "tavily", None)], "query long, provider string, payload string")
    got = rows(payloads.read_hits(frame, 10), "provider", "rank")
    assert got == [(1, "brave", 0, "T", "u1", "d", "brave"), (1, "brave", 1, "", "u3", "", "brave"), (1, "ddg", 0, "A", "l", "s", "ddg"), (1, "ddg", 1, "", "h", "z", "ddg")]
    assert len(rows(payloads.read_hits(frame, 1))) == 2


def test_readers(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"name": "n", "url": "u", "category": "c", "extra": 1}]))
    base = spark.createDataFrame([("d", "u0", "c", "note", True)], payloads.CASES)
    assert rows(payloads.read_cases(spark, str(tmp_path / "cases.json"), base), "name") == [("d", "u0", "c", "note", True), ("n", "u", "c", "", False)]
    (tmp_path / "bodies").mkdir()
    (tmp_path / "bodies" / "a.txt").write_bytes(b"ok \xff\xfe end")
    assert payloads.read_bodies(spark, str(tmp_path / "bodies")).first()["text"] == "ok �� end"
    sinks.write_transcripts(spark.createDataFrame([("one\ntwo\n",)], "text string"), str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["one", "two"]
    assert json.loads(sinks.as_json(base, "name").first()["json"])["category"] == "c"


def attempts(spark, given):
    return spark.createDataFrame([(k, datetime(2026, 1, 1, 0, k), *g) for k, g in enumerate(given)], payloads.FETCH)


def test_capture_choice(spark):
    long, short = "x" * 600, "y" * 80
    log = attempts(
        spark,
        [
            ("https://a.com", "browser", 200, long, {}),
            ("https://a.com", "direct", 403, long, {}),
            ("https://b.com", "direct", 200, short, {}),
            ("https://b.com", "relay", 200, short + "z", {}),
            ("https://b.com", "browser", 200, "px-captcha" + long, {}),
            ("https://c.com", "direct", None, None, None),
            ("https://c.com", "martian", 200, long, {}),
            ("https://d.com", "direct", 200, short, {}),
            ("https://d.com", "human", 200, long, {}),
        ],
    )
    judged = capture.judged(log, ladder=("direct", "relay", "browser", "human"))
    got = {r["url"]: r for r in capture.selected(judged, allow_thin=True).collect()}
    assert (got["https://a.com"]["attempt_id"], got["https://a.com"]["trace"]) == (0, "direct: http-403")
    assert (got["https://b.com"]["attempt_id"], got["https://b.com"]["thin"]) == (3, True)
    assert got["https://b.com"]["trace"] == "direct: thin-80b; relay: thin-81b; browser: challenge"
    assert got["https://c.com"]["attempt_id"] is None and "martian: unknown-backend" in got["https://c.com"]["trace"]
    assert (got["https://d.com"]["attempt_id"], got["https://d.com"]["thin"]) == (8, False)
    strict = capture.selected(judged)
    assert rows(capture.failed(strict).select("url"), "url") == [("https://b.com",), ("https://c.com",)]
    assert rows(capture.bodies(strict, log).select("url", "backend"), "url") == [("https://a.com", "browser"), ("https://d.com", "human")]


def test_memory(spark):
    long = "x" * 600
    log = attempts(spark, [("https://w.a.com/1", "relay", 200, long, {}), ("https://a.com/2", "direct", 200, long, {}), ("https://x.a.com/3", "relay", 403, long, {}), ("https://a.com/4", "direct", 200, long, {})])
    judged = capture.judged(log)
    got = rows(capture.with_memory(judged).select("attempt_id", "remembered", "ord"), "attempt_id")
    assert got == [(0, None, 2), (1, "relay", 1), (2, "direct", 2), (3, "direct", 0)]
    assert rows(capture.domain_memory(judged)) == [("a.com", "direct")]


def test_captures_are_judged_by_their_text(spark):
    """A page of 3 kB may hold 100 characters of text."""
    head, script = "<html><head><script>" + "var x = 1;" * 150 + "</script><style>", "p{color:red}" * 100 + "</style></head>"
    shell = head + script + "<body><div class='wrap'>" + "t" * 100 + "</div></body></html>"
    full = "<p>" + "&amp;" * 600 + "</p>"
    log = attempts(spark, [("https://a.com", "direct", 200, shell, {}), ("https://a.com", "browser", 200, full, {}), ("https://b.com", "relay", 200, shell, {}), ("https://c.com", "direct", 200, shell + "px-captcha", {}), ("https://d.com", "direct", 200, shell, {}), ("https://e.com", "direct", 200, None, None)])
    assert len(shell) > 2800
    ledger = capture.ledger(log)
    assert rows(ledger.select("attempt_id", "size", "reason"), "attempt_id") == [(0, 100, "thin-100b"), (1, 600, None), (2, len(shell), None), (3, None, "challenge"), (4, 100, "thin-100b"), (5, 0, "thin-0b")]
    got = {r["url"]: r for r in capture.selected(ledger).collect()}
    assert (got["https://a.com"]["attempt_id"], got["https://a.com"]["trace"]) == (1, "direct: thin-100b")
    assert got["https://d.com"]["attempt_id"] is None
    best = capture.texts(capture.selected(ledger, allow_thin=True), log)
    assert {r["url"]: r["text"] for r in best.collect()}["https://d.com"] == "t" * 100
    assert rows(capture.domain_memory(ledger), "domain") == [("a.com", "browser"), ("b.com", "relay")]


def test_a_person_comes_last(spark):
    page = lambda n: "<p>" + "y" * n + "</p>"
    log = attempts(
        spark,
        [
            ("https://a.com", "direct", 200, page(80), {}),
            ("https://a.com", "human", 200, page(700), {}),
            ("https://b.com", "direct", 200, page(80), {}),
            ("https://b.com", "human", 200, page(80), {}),
            ("https://c.com", "direct", 200, page(80), {}),
            ("https://c.com", "human", 200, page(81), {}),
            ("https://d.com", "direct", 200, page(900), {}),
            ("https://d.com", "human", 200, page(950), {}),
            ("https://e.com", "human", 200, "px-captcha" + page(900), {}),
            ("https://f.com", "human", 200, "", {}),
        ],
    )
    ledger = capture.ledger(log, ladder=("direct", "relay", "browser", "human"))
    got = {r["url"][8]: (r["attempt_id"], r["thin"], r["trace"]) for r in capture.selected(ledger, allow_thin=True).collect()}
    assert got == {"a": (1, False, "direct: thin-80b"), "b": (2, True, "direct: thin-80b"), "c": (5, True, "direct: thin-80b"), "d": (6, False, ""), "e": (None, False, ""), "f": (None, False, "")}
    assert rows(capture.domain_memory(ledger)) == [("d.com", "direct")]


def test_chat_first(spark):
    shared = spark.createDataFrame([("u1", "claude", "md")], "url string, provider string, markdown string")
    pages = spark.createDataFrame([("u1", "direct", 200, "page"), ("u2", "relay", 200, "p2")], "url string, backend string, status int, text string")
    assert rows(capture.chat_first(shared, pages), "url") == [("u1", "share:claude", 200, "md"), ("u2", "relay", 200, "p2")]


def test_download_plan_skips_and_goes_on(spark):
    schema = "page_id long, kind string, ord int, url string, ok boolean, bytes long, error string"
    given = [(1, "icons", 0, "a", True, 5, None), (1, "images", 0, "b", True, 60, None), (1, "images", 1, "c", True, 50, None), (1, "images", 2, "d", False, None, "http-404"), (1, "fonts", 0, "b", True, 60, None), (1, "css", 0, "e", True, 40, None), (1, "fonts", 1, "f", True, 1, None), (1, "scripts", 0, "g", True, 1, None)]
    plan = assets.download_plan(spark.createDataFrame(given, schema), max_assets=3, max_bytes=105)
    got = [(r["url"], r["ok"], r["error"]) for r in plan.collect()]
    assert got == [("b", True, None), ("c", False, "size-cap"), ("d", False, "http-404"), ("a", True, None), ("e", True, None)]


def test_whole_manifests(spark):
    html = '<title>T</title><meta name="theme-color" content="#123"><img src="/i/a.png"><link rel="stylesheet" href="s.css">'
    pages = spark.createDataFrame([(1, "https://e.com/p", html, "direct", "# md"), (2, "https://e.com/q", "<p>x</p>", "relay", None)], "page_id long, url string, html string, backend string, markdown string")
    sheets = spark.createDataFrame([("https://e.com/s.css", "@font-face{src:url(f/a.png)} .x{color:#ff0000;font-family:Inter}")], "css_url string, css string")
    listed = assets.pattern_assets(pages)
    every = assets.page_fonts(listed, sheets)
    answers = spark.createDataFrame([("https://e.com/i/a.png", True, 5, None, "image/png", "https://e.com/i/a.png", "direct"), ("https://e.com/f/a.png", True, 90, None, None, None, "direct"), ("https://e.com/s.css", False, None, "http-404", None, None, None)], "url string, ok boolean, bytes long, error string, content_type string, final_url string, backend string")
    plan = assets.download_plan(assets.answered(every, answers), max_bytes=50)
    rows_ = assets.manifests(pages, assets.design(pages, listed, sheets), every, plan)
    got = {r["page_id"]: r.asDict(recursive=True) for r in rows_.collect()}
    assert got[1] == {
        "page_id": 1, "url": "https://e.com/p", "title": "T", "page_backend": "direct", "theme_color": "#123", "palette": [{"hex": "#112233", "count": 1}, {"hex": "#ff0000", "count": 1}], "fonts": ["Inter"],
        "found": {"images": 1, "icons": 0, "css": 1, "fonts": 1, "svg": 0, "scripts": 0}, "downloaded": 1, "page_md": "page.md",
        "assets": [
            {"source_url": "https://e.com/i/a.png", "kind": "images", "ok": True, "local_path": "images/a.png", "bytes": 5, "content_type": "image/png", "backend": "direct", "error": None},
            {"source_url": "https://e.com/s.css", "kind": "css", "ok": False, "local_path": None, "bytes": None, "content_type": None, "backend": None, "error": "http-404"},
            {"source_url": "https://e.com/f/a.png", "kind": "fonts", "ok": False, "local_path": None, "bytes": None, "content_type": None, "backend": None, "error": "size-cap"},
        ],
    }
    assert got[2]["palette"] == [] and got[2]["assets"] == [] and got[2]["downloaded"] == 0 and got[2]["found"]["images"] == 0 and got[2]["page_md"] is None


def test_a_page_of_very_many_fetches(spark):
    """A batch and two numbers are all that a worker holds."""
    n = 1_000_000
    fetches = spark.range(n).selectExpr("1L AS page_id", "'images' AS kind", "CAST(id AS INT) AS ord", "concat('u', id) AS url", "id % 5 <> 0 AS ok", "IF(id % 1000 = 1, 900000L, 10L) AS bytes", "CAST(NULL AS STRING) AS error")
    plan = assets.download_plan(fetches, max_assets=n, max_bytes=5_000_000)
    taken = total = capped = 0
    for k in range(n):
        size = 900000 if k % 1000 == 1 else 10
        if k % 5 and total + size <= 5_000_000:
            taken, total = taken + 1, total + size
        elif k % 5:
            capped += 1
    assert plan.agg(F.count_if("ok"), F.sum("bytes"), F.count_if(F.col("error") == "size-cap"), F.count("*")).first() == (taken, total, capped, n)


def test_names_that_clash(spark):
    draw = random.Random(6)
    given = [(draw.randrange(3), "css", k, f"u{k}", draw.choice(["a", "a-1", "a-1-1", "a-2", "b.x.y", "b.x-1.y", ".h", "c-3"]) + draw.choice(["", ".png", ".png"])) for k in range(300)]
    want, taken = {}, set()
    for page, kind, k, _, name in given:
        stem, suffix = (name.rsplit(".", 1)[0], "." + name.rsplit(".", 1)[1]) if "." in name[1:] else (name, "")
        path, i = name, 1
        while (page, path) in taken:
            path, i = f"{stem}-{i}{suffix}", i + 1
        taken.add((page, path))
        want[k] = path
    named = spark.createDataFrame(given, "page_id long, kind string, ord int, url string, name string").repartition(5)
    assert {r["ord"]: r["path"] for r in assets.unique_names(named).collect()} == want


def test_names_and_sheets(spark):
    named = spark.createDataFrame([(1, "images", k, f"u{k}", n) for k, n in enumerate(["a.png", "a-1.png", "a.png", "a.png", "b"])], "page_id long, kind string, ord int, url string, name string")
    assert [r["path"] for r in assets.unique_names(named).orderBy("ord").collect()] == ["a.png", "a-1.png", "a-2.png", "a-3.png", "b"]
    sheets = spark.createDataFrame([("https://c.e/d/s.css", "@font-face{src:url('a.eot');src:url(b.woff2)} .x{background:url(no.png)} @FONT-FACE { src: url(/c.ttf) }")], "css_url string, css string")
    assert [r["url"] for r in assets.sheet_fonts(sheets).orderBy("ord").collect()] == ["https://c.e/d/a.eot", "https://c.e/d/b.woff2", "https://c.e/c.ttf"]
    assert spark.range(1).select(assets.wanted_kinds(F.lit("Images, css"), F.lit(True))).first()[0] == ["images", "css", "scripts"]


def test_palette_order(spark):
    pages = spark.createDataFrame([(1, ["#abc rgb(0,0,1) #abc #010203", "#010203 #ff0000"])], "page_id long, blobs array<string>")
    assert [(r["hex"], r["n"]) for r in assets.palette(pages).orderBy("rank").collect()] == [("#aabbcc", 2), ("#010203", 2), ("#000001", 1), ("#ff0000", 1)]


def chat(spark, provider, payload):
    raw = spark.createDataFrame([("u", provider, payload)], "url string, provider string, payload string")
    got = chats.read_chats(raw).collect()
    return (got[0]["title"], [tuple(t) for t in got[0]["turns"]]) if got else None


def test_chat_payloads(spark):
    claude = {"snapshot_name": "N", "chat_messages": [{"index": 1, "sender": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b"}]}, {"index": 0, "sender": "human", "text": "q", "content": []}, {"index": 2, "sender": "tool", "text": "x"}]}
    assert chat(spark, "claude", json.dumps(claude)) == ("N", [("User", "q"), ("Claude", "a\n\nb")])
    grok = {"conversation": {"title": "G"}, "responses": [{"message": " late ", "sender": "ASSISTANT", "createTime": "2"}, {"message": "", "query": "q", "sender": "Human", "createTime": "1"}, {"message": "no", "isControl": True}]}
    assert chat(spark, "grok", json.dumps(grok)) == ("G", [("User", "q"), ("Grok", "late")])
    pool = [{"_1": 2}, "linear_conversation", [3, 9], {"_4": 5}, "message", {"_6": 7, "_12": 13}, "author", {"_8": 11}, "role", {"_4": 10}, ["P", 1], "user", "content", {"_14": 15}, "parts", [16], "hi"]
    page = f"<script>streamController.enqueue({json.dumps(json.dumps(pool))});</script>"
    assert chat(spark, "chatgpt", page) == (None, [("User", "hi")])
    inner = [[None, [[None, None, [["q"]], [[["r"], ["a"]]]]], [None, "T"]]]
    root = json.dumps([[None, [[None, None, [["q"]], [[["r"], ["a"]]]]], [None, "T"]]])
    assert json.loads(root) == inner
    assert chat(spark, "gemini", ")]}'\n\n12\n" + json.dumps([["wrb.fr", "other", "x"], ["wrb.fr", "ujx1Bf", root]]))[1] == [("User", "q")]
    deep = json.dumps([[None, [[None, None, [["q"]], [[[None, ["a"]]]]]], [None, "T"]]])
    assert chat(spark, "gemini", json.dumps([["wrb.fr", "ujx1Bf", deep]])) == ("T", [("User", "q"), ("Gemini", "a")])
    poe = {"x": [{"chatShare": {"chatBot": {"displayName": "B"}, "messagesConnection": {"edges": [{"node": {"text": "q", "author": "human"}}, {"node": {"text": "a", "author": "b"}}, {"node": None}]}}}]}
    assert chat(spark, "poe", f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(poe)}</script>') == ("B", [("User", "q"), ("B", "a")])
    assert chat(spark, "poe", "<html>") is None and chat(spark, "claude", "nope") is None and chat(spark, "gemini", "") is None


def test_chat_pages(spark):
    deepseek = '<div class="ds-message">q <b>1</b><script>x</script></div><div class="ds-message"><p>think</p><div class="ds-assistant-message-main-content"><p>a</p><br><p>b</p></div></div>'
    assert chat(spark, "deepseek", deepseek) == (None, [("User", "q 1"), ("DeepSeek", "a\n\nb")])
    perplexity = '<div class="x group/query">' + "w " * 50 + '</div><div id="markdown-content-0">a</div><div id="markdown-content-0">a</div>'
    title, turns = chat(spark, "perplexity", perplexity)
    assert title.endswith("...") and len(title) <= 80 and [r for r, _ in turns] == ["User", "Perplexity"]
    copilot = '<div role="article" class="group/user-message"><h6>You said</h6>q</div><div role="article"><h6>Copilot said</h6><img src=x>a</div>'
    assert chat(spark, "copilot", copilot) == (None, [("User", "q"), ("Copilot", "a")])


def test_rendering(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", " a "), (1, 0, "user", "q"), (1, 2, "system", "s"), (1, 3, "user", " ")], "conv_id long, turn long, role string, text string")
    assert rows(chats.rendered(chats.mapped_turns(turns, F.lit("Bot")))) == [(1, "**User:**\n\nq\n\n**Bot:**\n\na")]
    assert chats.first_key({"a": [{"b": None}, {"b": 3}], "b": None}, "b") == 3
    assert chats.tidy("a \xa0 b \n\n\n\n c ") == "a b\n\nc"


def test_captions(spark):
    vtt = "WEBVTT\r\nKind: captions\n\nNOTE x\n1\n00:01 --> 00:02\n<c>hello</c> there\nhello there\n\n2\nhello there\nagain\nhello there"
    tracks = spark.createDataFrame([(1, "v.AUTO.vtt", "x"), (1, "v.z.vtt", vtt), (2, "b.a.en.vtt", "y"), (2, "c.auto.vtt", "n")], "video_id long, track string, vtt string")
    best = captions.chosen_tracks(tracks)
    assert rows(best.select("video_id", "track"), "video_id") == [(1, "v.z.vtt"), (2, "b.a.en.vtt")]
    assert best.where("video_id = 1").select(captions.prose(F.col("vtt"))).first()[0] == "hello there\nagain\nhello there"
    tries = spark.createDataFrame([(1, 0, 0, False, None, "e0"), (1, 0, 1, True, " t ", None), (1, 1, 0, False, None, "e0"), (1, 1, 1, False, None, "e1"), (1, 2, 0, True, "u", None)], "video_id long, chunk int, provider_ord int, ok boolean, text string, error string")
    chunks = captions.chunk_texts(tries)
    assert rows(chunks, "chunk") == [(1, 0, " t ", None), (1, 1, None, "e1"), (1, 2, "u", None)]
    said = captions.stitched(chunks)
    assert rows(said) == [(1, "t\nu")]
    caps = spark.createDataFrame([(1, "short"), (2, "long enough to be used here")], "video_id long, text string")
    assert rows(captions.transcripts(caps, said), "video_id") == [(1, "speech", "t\nu"), (2, "captions", "long enough to be used here")]
    audio = spark.createDataFrame([(1, 10, 900), (2, 1 << 30, 1300), (3, 1 << 30, 600)], "video_id long, bytes long, seconds int")
    assert rows(captions.chunk_plan(audio), "video_id", "chunk") == [(1, 0, 0, 900), (2, 0, 0, 600), (2, 1, 600, 600), (2, 2, 1200, 100), (3, 0, 0, 600)]


def test_scorecard(spark):
    cases = spark.createDataFrame([("a", "u1", "x", "", False), ("b", "u2", "x", "", True), ("c", "u3", "y", "", False), ("d", "u4", "y", "", False)], payloads.CASES)
    caps = spark.createDataFrame([("u1", "direct", 200, 900, None), ("u2", "relay", 200, 10, None), ("u3", "direct", 200, 10, None), ("u4", None, None, 0, "e" * 300)], "url string, backend string, status int, chars long, error string")
    scored = scorecard.scored(cases, caps)
    assert [r["ok"] for r in scored.orderBy("name").collect()] == [True, True, False, False]
    assert [r["error"] for r in scored.orderBy("name").collect()] == [None, None, "thin content (10 < 500 chars)", "e" * 200]
    totals = scorecard.summary(scored)
    assert rows(totals.drop("first"), "kind", "name") == [("all", None, 2, 4, 0.5), ("category", "x", 2, 2, 1.0), ("category", "y", 0, 2, 0.0), ("tier", "direct", 1, 1, 1.0), ("tier", "relay", 1, 1, 1.0)]
    assert scorecard.card(totals).first()[0].split("\n") == ["Read **2/4** pages (**50%**).", "", "## Which tier carried it", "", "- `direct`: 1", "- `relay`: 1", "", "## By category", "", "- `x`: 2/2 (100%)", "- `y`: 0/2 (0%)"]
    assert "| d | y | no | — | 0 |" in [r["line"] for r in scorecard.page_lines(scored).collect()]
    docs = spark.createDataFrame([("s", "system prompt, system prompt"), ("t", "fine")], "source string, text string")
    assert rows(scorecard.injection_rollup(docs), F.col("source").asc_nulls_first(), F.col("pattern").asc_nulls_first()) == [(None, None, 1, 2), ("s", None, 1, 2), ("s", 4, 1, 2)]


def test_whole_scorecard(spark, tmp_path):
    """Of tiers that read as much the first seen comes first."""
    cases = spark.createDataFrame([("a", "u1", "x", "", False, 0), ("b", "u2", "y", "", False, 1), ("c", "u3", "x", "", False, 2)], "name string, url string, category string, note string, allow_thin boolean, ord int")
    caps = spark.createDataFrame([("u1", "relay", 200, 900, None), ("u2", "direct", 200, 700, None)], "url string, backend string, status int, chars long, error string")
    results = scorecard.scored(cases, caps)
    assert scorecard.card(scorecard.summary(results)).first()[0].split("\n")[4:6] == ["- `relay`: 1", "- `direct`: 1"]
    scorecard.write_card(results, str(tmp_path / "card"))
    want = ["# Capture scorecard", "", "Read **2/3** pages (**67%**).", "", "## Which tier carried it", "", "- `relay`: 1", "- `direct`: 1", "", "## By category", "", "- `x`: 1/2 (50%)", "- `y`: 1/1 (100%)", "", "## Per page", ""]
    want += ["| Page | Category | Read | Tier | Chars |", "|------|----------|:----:|------|------:|", "| a | x | yes | `relay` | 900 |", "| b | y | yes | `direct` | 700 |", "| c | x | no | — | 0 |"]
    files = sorted((tmp_path / "card").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == want
    none = scorecard.scored(cases, caps.limit(0))
    assert "- (nothing read)" in [r["line"] for r in scorecard.lines(none).collect()]


def test_streams_equal_batches(spark, tmp_path):
    long = "x" * 600
    log = attempts(spark, [("https://a.com/1", "relay", 200, long + "​", {}), ("https://a.com/2", "direct", 200, long, {}), ("https://b.com/3", "relay", 403, long, {}), ("https://b.com/4", "direct", 200, "system prompt" + long, {})])
    log.repartition(4, "attempt_id").write.parquet(str(tmp_path / "in"))
    stream = landing.landing(spark, str(tmp_path / "in"), files_per_trigger=1)
    landing.append_to(landing.classified(stream), str(tmp_path / "out"), str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    batch = landing.classified(log)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "attempt_id") == rows(batch, "attempt_id")
    best = landing.latest_backend(landing.classified(landing.landing(spark, str(tmp_path / "in"), files_per_trigger=1)))
    best.writeStream.outputMode("complete").format("memory").queryName("best").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("best"), "domain") == rows(landing.latest_backend(batch), "domain")


def test_clean_pages_of_a_memory_are_judged_once(spark):
    long = "<p>" + "x" * 600 + "</p>"
    log = attempts(spark, [("https://a.com/1", "relay", 200, long, {}), ("https://b.com/2", "direct", 200, "<p>x</p>" + " " * 600, {}), ("https://c.com/3", "direct", 403, long, {}), ("https://d.com/4", "direct", 200, None, {}), ("https://e.com/5", "human", 200, long, {}), ("https://f.com/6", None, 200, long, {}), ("https://g.com/7", "direct", None, long, {})])
    judged, own = landing.classified(log), landing.clean(log)
    assert rows(own, "attempt_id") == rows(judged.where("reason is null and not thin").select(*own.columns), "attempt_id")
    assert rows(landing.latest_backend(own)) == rows(landing.latest_backend(judged))
    plan = landing.latest_backend(own)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("noscript") == 1 and "exfiltrate" not in plan


def test_memory_expires_and_survives_a_restart(spark, tmp_path):
    """Three runs from one checkpoint, each ended and begun anew: a domain goes when
    the watermark passes it, comes back, and late pages change nothing."""
    long, own = "x" * 600, landing.with_rocksdb(spark)

    def run(first, given):
        frame = spark.createDataFrame([(first + k, datetime(2026, 1, d, h), u, b, 200, long, {}) for k, (d, h, u, b) in enumerate(given)], payloads.FETCH)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = landing.remembered(landing.classified(landing.landing(own, str(tmp_path / "in"))), timedelta(hours=24))

        def keep(batch, epoch):
            batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"epoch={epoch}"))

        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return rows(landing.remembered_now(spark.read.parquet(str(tmp_path / "out")), "epoch"), "domain")

    assert run(0, [(1, 0, "https://a.com", "direct"), (1, 5, "https://b.com", "relay"), (1, 3, "https://a.com", "relay"), (1, 4, "https://c.com", "human")]) == [("a.com", "relay"), ("b.com", "relay")]
    # a.com is 26 hours old when b.com's page comes; c.com's page is new.
    assert run(10, [(2, 5, "https://c.com", "browser"), (2, 1, "https://b.com", "direct")]) == [("b.com", "direct"), ("c.com", "browser")]
    assert run(20, [(2, 6, "https://a.com", "browser"), (2, 2, "https://c.com", "direct")]) == [("a.com", "browser"), ("b.com", "direct"), ("c.com", "browser")]
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert rows(changes.where("forgotten").select("domain", "backend")) == [("a.com", "relay")]
