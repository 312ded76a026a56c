"""Secret scan in DataFrame functions only: fixed patterns, and sliding-window
Shannon entropy per character class with an allow list."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties of position.
KINDS = ("assign", "access", "hex", "entropy")
#: Group 1 is the assigned value; it counts from ASSIGN_VALUE characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
#: A run is as long as it can be, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"

_SCALE = 1 << 32


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``alphabet`` of at least ``window`` characters are candidates; a
    window is suspicious from ``bits`` of entropy a character."""

    name: str
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        own = "".join("\\" + c if c in "-+/" else c for c in self.alphabet)
        return f"(?<![{own}])[{own}]{{{self.window},}}+"


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _counting(run: str, least: int = 6) -> str:
    """The first ``least`` characters of ``run`` and as many more as follow."""
    rest = ""
    for c in reversed(run[least:]):
        rest = f"(?:{c}{rest})?"
    return run[:least] + rest


#: Whole parts of a candidate, a part being a run of letters and digits.  Real
#: words have one case, a capital in front or humps, never three short humps,
#: seven consonants or a q without u in a row, nor three of j, q, x and z.
_WORD = (
    r"(?![A-Za-z]*[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{7})(?![A-Za-z]*[qQ](?=[A-Za-z])[^uU])(?!(?:[A-IK-PR-WYa-ik-pr-wy]*[jqxzJQXZ]){3})"
    r"(?:[A-Z]+|(?![A-Za-z]*(?:[A-Z][a-z]){3})[a-z]*(?:[A-Z][a-z]+){0,20})"
)
_NUMBER = "[0-9]+"
_PLACEHOLDER = r"(?i:example|sample|dummy|placeholder|changeme)[A-Za-z0-9]*|[xX]{6,}[A-Za-z0-9]{0,4}"
_COUNT = f"(?i:{_counting(_DIGITS)}|{_counting('1234567890')}|{_counting(_LOWER)}){{1,50}}"


def _all_parts(*kinds: str) -> str:
    """The start of a text all of whose parts are of these kinds."""
    return rf"^(?!.*(?<![A-Za-z0-9])(?!(?:{'|'.join(kinds)})(?![A-Za-z0-9]))[A-Za-z0-9])"


@dataclass(frozen=True)
class EntropyRules:
    classes: tuple[EntropyClass, ...] = (
        EntropyClass("hex", _DIGITS + "abcdef", 16, 2.8),
        EntropyClass("upper", _UPPER + _DIGITS, 16, 3.2),
        EntropyClass("base64", _UPPER + _LOWER + _DIGITS + "+/_-=", 20, 3.6),
    )
    #: A candidate that matches one of these is no secret: words, plain numbers
    #: (cards, phones, dates), and words and numbers with a placeholder or a
    #: counting run.  Each tests all parts: a harmless one excuses no other.
    allow: tuple[str, ...] = (
        _all_parts(_WORD) + "[A-Za-z_/=-]+$",
        "^[0-9+/_-]+$",
        _all_parts(_WORD, _NUMBER, _PLACEHOLDER, _COUNT) + rf".*(?<![A-Za-z0-9])(?:{_PLACEHOLDER}|{_COUNT})(?![A-Za-z0-9])",
    )
    #: Exact candidates that are known to be harmless.
    allow_values: tuple[str, ...] = field(default=())


_SPANS = "array<struct<start:int,kind:int,end:int,hit:string>>"
#: What stands for a count of 0 in a string of counts.
_ZERO = 64
#: Elements of an array that are scanned together.
_BLOCK = 256
#: Characters of the parts that a text is cut into before spans are cut out.
_PART = 4096


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, zero: int, op) -> Column:
    """For each element ``op`` over all earlier ones, ``zero`` for the first.

    Built-in functions have no running fold, and one that appends to an array
    copies it at each step.  So it runs within blocks of 256 elements, and
    over the blocks: n * 256 + (n / 256)^2 copies instead of n^2.
    """
    empty = F.array().cast("array<int>")

    def run(x: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), empty.alias("out"))
        return F.aggregate(x, start, lambda s, v: F.struct(op(s["now"], v).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")), lambda s: s["out"])

    whole = lambda x: F.aggregate(x, F.lit(zero), op)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.greatest((F.size(v) - 1) / _BLOCK, F.lit(0)).cast("int")), lambda k: F.slice(v, k * _BLOCK + 1, _BLOCK))
    blocks = lambda x: F.flatten(F.zip_with(x, run(F.transform(x, whole), F.lit(zero)), run))
    return _let(_let(values, cut), blocks)


def _spans(text: Column, pattern: str, kind: int, value_length: int = 0) -> Column:
    """array<struct<start, kind, end, hit>> of a pattern's matches, leftmost and
    not overlapping, in code points; empty where there is none."""
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(found: Column) -> Column:
        sizes = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda hit, gap: F.length(gap) + F.length(hit))
        ends = _let(sizes, lambda x: F.zip_with(_before(x, 0, lambda s, n: s + n), x, lambda before, n: before + n))
        return F.zip_with(found, ends, lambda hit, end: F.struct((end - F.length(hit)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), hit.alias("hit")))

    spans = _let(hits, placed)
    if value_length:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("span"), values.alias("value")), lambda x: F.length(x["value"]) >= value_length), lambda x: x["span"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def _suspicious(span: Column, of: EntropyClass) -> Column:
    """The part of a candidate that suspicious windows cover, or null.

    A window's counts stand in a string, a character for each letter of the
    alphabet; a step changes two of them, the arrival's and the departure's,
    and with them the sum of c*log2(c), held in whole 2^-32 parts so that no
    rounding gathers; entropy = log2(w) - sum/w.  A step costs the same
    however long the candidate is.
    """
    w, table = of.window, [0, *(round(c * math.log2(c) * _SCALE) for c in range(1, of.window + 2))]
    weight = F.array(*(F.lit(x).cast("long") for x in table))
    most = round(w * (math.log2(w) - of.bits) * _SCALE)
    count = lambda counts, code: F.ascii(F.substring(counts, code, F.lit(1))) - _ZERO
    put = lambda counts, code, n: F.overlay(counts, F.char(n + _ZERO), code, F.lit(1))

    def step(s: Column, x: Column) -> Column:
        a, b, i = x["a"], x["b"], s["i"] + 1
        ca, cb = count(s["n"], a), count(s["n"], b)
        gain = F.get(weight, ca + 1) - F.get(weight, ca) + F.when(b > 0, F.get(weight, cb - 1) - F.get(weight, cb)).otherwise(F.lit(0))
        total = F.when(a == b, s["sum"]).otherwise(s["sum"] + gain)
        arrived = put(s["n"], a, ca + 1)
        counts = F.when(a == b, s["n"]).when(b > 0, put(arrived, b, cb - 1)).otherwise(arrived)
        hot = (i >= w) & (total <= most)
        return F.struct(
            i.alias("i"),
            counts.alias("n"),
            total.cast("long").alias("sum"),
            F.when(hot & (s["first"] < 0), i - w).otherwise(s["first"]).alias("first"),
            F.when(hot, i).otherwise(s["last"]).alias("last"),
        )

    codes = F.transform(F.slice(F.split(span["hit"], ""), 1, F.length(span["hit"])), lambda c: F.instr(F.lit(of.alphabet), c))
    # The letter w places before leaves as one arrives; 0 stands for none.
    moves = lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(F.lit(0), w), c), 1, F.size(c)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    zero = F.struct(F.lit(0).alias("i"), F.lit(chr(_ZERO) * len(of.alphabet)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    part = F.aggregate(_let(codes, moves), zero, step)
    return _let(part, lambda p: F.struct((span["start"] + p["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (span["start"] + p["last"]).alias("end"), p["first"].alias("first")))


def _entropy_spans(text: Column, of: EntropyClass, rules: EntropyRules) -> Column:
    candidates = _spans(text, of.pattern, KINDS.index("entropy"))

    def wanted(span: Column) -> Column:
        fine = F.lit(False)
        for pattern in rules.allow:
            fine = fine | span["hit"].rlike(pattern)
        if rules.allow_values:
            fine = fine | span["hit"].isin(*rules.allow_values)
        return ~fine

    parts = F.transform(F.filter(candidates, wanted), lambda span: _suspicious(span, of))
    return F.transform(F.filter(parts, lambda p: p["first"] >= 0), lambda p: F.struct(p["start"], p["kind"], p["end"]))


def _distinct(spans: Column) -> Column:
    """Sorted and each once: a span goes if it equals the one before it."""
    return _let(F.sort_array(spans), lambda x: F.filter(x, lambda s, k: (k == 0) | (s != F.get(x, k - 1))))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, text_col: str = "text", rules: EntropyRules | None = None, prefix: str = "secret_") -> DataFrame:
    """Adds ``<prefix>assign``, ``<prefix>access``, ``<prefix>hex`` and
    ``<prefix>entropy``: sorted array<struct<start, kind, end>> in code points.

    The first three are the base patterns, always kept whole.  The last holds
    the suspicious part of each candidate of each character class, once if two
    classes agree.  A null text counts as empty.  Columns of docs that have one
    of these names are replaced.  Row by row: no shuffle.
    """
    rules = rules or EntropyRules()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return docs.withColumns(
        {
            f"{prefix}assign": bare(_spans(text, ASSIGN, 0, ASSIGN_VALUE)),
            f"{prefix}access": bare(_spans(text, ACCESS, 1)),
            f"{prefix}hex": bare(_spans(text, HEX, 2)),
            f"{prefix}entropy": _distinct(F.concat(*(_entropy_spans(text, c, rules) for c in rules.classes))),
        }
    )


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: EntropyRules | None = None) -> DataFrame:
    """A row per document: its id, counts of the base kinds, a hash of the base
    spans and all spans as text (``kind:start:end``, comma-joined)."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rules)
    base = F.concat("secret_assign", "secret_access", "secret_hex")
    return found.select(
        "doc_id",
        *(F.size(f"secret_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, "secret_entropy")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", marker: str = "[SECRET]", rules: EntropyRules | None = None) -> DataFrame:
    """Every document with each secret in its text replaced by ``marker``;
    overlapping or touching spans count as one.  Other columns stay, whatever
    their names; a null text stays null."""
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = scan(own, "text", rules, "")
    spans = F.sort_array(F.concat(*(F.col(k) for k in KINDS)))

    def cut(x: Column) -> Column:
        """The text between the spans, joined by the marker."""
        done = _before(F.transform(x, lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b))
        gaps = F.filter(F.zip_with(x, done, lambda s, d: F.struct(d.alias("a"), s["start"].alias("b"))), lambda g, k: (k == 0) | (g["b"] > g["a"]))
        last = F.struct(F.array_max(F.transform(x, lambda s: s["end"])).alias("a"), F.length("text").alias("b"))
        # Cut out of parts of the text, not of the whole: a gap costs its own length.
        parts = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))

        def piece(p: Column, g: Column) -> Column:
            first = F.floor(g["a"] / _PART).cast("int")
            near = F.array_join(F.slice(p, first + 1, F.floor(g["b"] / _PART).cast("int") - first + 1), "")
            return F.substring(near, g["a"] - first * _PART + 1, g["b"] - g["a"])

        return _let(parts, lambda p: F.array_join(F.transform(F.concat(gaps, F.array(last)), lambda g: piece(p, g)), marker))

    clean = found.select("row", "text", spans.alias("spans")).select("row", F.when(F.size("spans") > 0, _let(F.col("spans"), cut)).otherwise(F.col("text")).alias("text"))
    return clean.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
