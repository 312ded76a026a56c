"""Quality rules in DataFrame functions only: repetition counts, and the
Jensen-Shannon distance of a document's histograms to its language's."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Fixed values for four languages: frequent words whose shares are compared.
#: Those of any other language are counted in the corpus.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
}
#: Character classes; what is in none of them is the last bin.
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()-]", r"[#*$%&|<>@=+/\\_~^{}\[\]`]")
#: White space among them.
_SPACES = 3


@dataclass(frozen=True)
class DivergenceRules:
    """Distances are compared from a least length on; shorter documents pass."""

    common_words: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(COMMON_WORDS))
    max_class_distance: float = 0.25
    max_word_distance: float = 0.32
    min_chars: int = 200
    min_words: int = 80


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, n: int = 5) -> Column:
    """Words that lie in an ``n``-word window found twice or more, the first
    included.  Windows are compared by 64-bit hashes, made of those of two
    shorter windows at an offset, so each word is hashed once; equal ones are
    found by sorting, so a long text costs n log n."""

    def joined(h: Column, offset: int) -> Column:
        return _let(h, lambda h: F.zip_with(h, F.slice(h, offset + 1, F.size(words)), lambda a, b: F.xxhash64(a, b)))

    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < n:
        longer = min(2 * width, n)
        hashes, width = joined(hashes, longer - width), longer
    # The last n - 1 are of windows that reach over the end.
    hashes = F.slice(hashes, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def count(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
            start = F.struct(F.lit(-n).alias("p"), F.lit(0).cast("long").alias("c"))
            add = lambda a, p: F.struct(p.alias("p"), (a["c"] + F.least(F.lit(n), p - a["p"])).alias("c"))
            return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["p"])), start, add, lambda a: a["c"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(placed, count))

    return F.when(F.size(words) > n, _let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def _share(counts: list[Column], total: Column) -> Column:
    """Shares of the counts and of what is left of the total, each count
    computed once."""
    whole = F.greatest(total, F.lit(1))
    rest = lambda c: F.aggregate(c, total.cast("long"), lambda left, x: left - x)
    shares = lambda c: F.transform(F.array_append(c, rest(c)), lambda x: (x / whole).cast("double"))
    return _let(F.array(*(c.cast("long") for c in counts)), shares)


def _padded(text: Column) -> Column:
    """Lower-case words, each between two spaces of its own."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", "  "), F.lit(" "))


def learned_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: DivergenceRules | None = None) -> DataFrame:
    """lang and ``listed``, the most frequent words of all documents of each
    language that the rules do not list; ties go to the first by name.  Lists
    are as long as those of the rules: null bytes, which no word has, fill up."""
    rules = rules or DivergenceRules()
    n = _list_size(rules)
    other = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & ~F.col("lang").isin(*rules.common_words))
    counted = other.select("lang", F.explode(F.array_remove(F.split(_padded(F.col("text")), " +"), "")).alias("word")).groupBy("lang", "word").count()
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("k") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"])
    return ranked.groupBy("lang").agg(listed.alias("listed")).select("lang", F.concat("listed", F.array_repeat(F.lit("\0"), F.lit(n) - F.size("listed"))).alias("listed"))


def _list_size(rules: DivergenceRules) -> int:
    sizes = {len(w) for w in rules.common_words.values()} or {16}
    if len(sizes) != 1:
        raise ValueError("every language needs as many common words")
    return sizes.pop()


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: DivergenceRules | None = None, learned: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, the base counts, and the two histograms as shares.

    ``learned`` has the common words of languages that the rules do not list;
    ``word_share`` is null where a language has none in either.
    """
    rules = rules or DivergenceRules()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("words", F.array_remove(F.split("text", SPACE), "")).withColumn("padded", _padded(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # The classes share no character: each is counted in what the ones before have left.
    own = own.withColumn("rest0", F.col("text"))
    for k, c in enumerate(CLASSES):
        own = own.withColumn(f"rest{k + 1}", F.regexp_replace(f"rest{k}", c + "+", ""))
    classes = [F.length(f"rest{k}") - F.length(f"rest{k + 1}") for k in range(len(CLASSES))]
    word_share = F.lit(None).cast("array<double>")
    if learned is not None:
        own = own.join(F.broadcast(learned.select("lang", "listed")), "lang", "left")
        times = lambda w: ((F.octet_length("padded") - F.octet_length(F.replace(F.col("padded"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("long")
        word_share = F.when(F.col("listed").isNotNull(), _let(F.transform("listed", times), lambda c: _share([F.get(c, F.lit(k)) for k in range(_list_size(rules))], F.size("words"))))
    for lang, listed in rules.common_words.items():
        counts = [((F.octet_length("padded") - F.octet_length(F.replace(F.col("padded"), F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("long") for w in listed]
        word_share = F.when(F.col("lang") == lang, _share(counts, F.size("words"))).otherwise(word_share)
    return own.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - classes[_SPACES]).cast("long").alias("word_chars"),
        # Symbols are of the last class.
        (F.length(f"rest{len(CLASSES) - 1}") - F.length(F.regexp_replace(f"rest{len(CLASSES) - 1}", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.length("text").alias("n_chars"),
        _share(classes, F.length("text")).alias("class_share"),
        word_share.alias("word_share"),
    )


def _mean(column: str, size: int, guard: Column) -> Column:
    return F.array(*(F.avg(F.when(guard, F.col(column)[k])) for k in range(size)))


def references(measured: DataFrame, rules: DivergenceRules | None = None) -> DataFrame:
    """Mean histograms of every language over all its documents that are long
    enough: as many rows as there are languages."""
    rules = rules or DivergenceRules()
    return (
        measured.where(F.col("lang").isNotNull())
        .groupBy("lang")
        .agg(
            _mean("class_share", len(CLASSES) + 1, F.col("n_chars") >= rules.min_chars).alias("class_reference"),
            _mean("word_share", _list_size(rules) + 1, F.col("n_words") >= rules.min_words).alias("word_reference"),
        )
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root, base 2) of two shares, 0 to 1."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: _let((a + b) / 2, lambda m: term(a, m) + term(b, m)))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: DivergenceRules | None = None) -> DataFrame:
    """A row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, class_distance, word_distance.

    Documents are compared with their language by both histograms.  Without a
    language, or a long enough document of it, there is no distance and none
    rejects.  A null text counts as empty: it has no words and fails.  The
    measures are written once, for the references need all of them before any
    document can be judged.
    """
    rules = rules or DivergenceRules()
    other = F.col(lang_col).isNotNull() & ~F.col(lang_col).cast("string").isin(*rules.common_words)
    learned = None if docs.where(other).isEmpty() else common.written(learned_words(docs, text_col, lang_col, rules), "quality-words")
    measured = common.written(measures(docs, id_col, text_col, lang_col, rules, learned), "quality-measures")
    known = common.written(references(measured, rules), "quality-references")
    # A row per language: small beside the documents.
    both = measured.join(F.broadcast(known), "lang", "left")
    joined = both.withColumns(
        {
            "class_distance": F.when(F.col("class_reference")[0].isNotNull(), jensen_shannon(F.col("class_share"), F.col("class_reference"))),
            "word_distance": F.when(F.col("word_reference")[0].isNotNull(), jensen_shannon(F.col("word_share"), F.col("word_reference"))),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    odd = (F.col("n_chars") >= rules.min_chars) & F.coalesce(F.col("class_distance") > rules.max_class_distance, F.lit(False))
    odd = odd | ((F.col("n_words") >= rules.min_words) & F.coalesce(F.col("word_distance") > rules.max_word_distance, F.lit(False)))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~odd).alias("kept"), "class_distance", "word_distance")
