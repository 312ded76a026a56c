"""The registered queries of this subpackage: each applies an operator with
production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, common, exact_dedup, fill_in_middle, language_crf, mixing, near_dup, packing, quality_mil, quality_rules, secrets, substring_dedup, token_store, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switched of all documents,
    by a model of those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = language_crf.fit(docs.where(~held_out()), key=F.col("doc_id"))
    return language_crf.predict(docs, model, "doc_id", held_out().alias("held_out"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality_mil.MilModel | None:
    """Learned from the labelled documents of the table that are not held out."""
    labels = _table(spark, sf_dir, "labels").where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return quality_mil.fit_labelled(_table(spark, sf_dir, "documents").where(~held_out()), labels)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, top_passage of all documents."""
    docs = _table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_model(spark, sf_dir), "doc_id", held_out().alias("held_out"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of all documents."""
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in sequences of 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, end_id=1)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of all documents, by five-word shingles at 0.8."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of all documents."""
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best others of every hundredth vector: query_id, rank, vec_id, score."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents."""
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def domain() -> Column:
    """Domains of the mixing query: sources are dealt to four by their number."""
    return F.concat(F.lit("d"), F.pmod(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(4)))


#: Target weights by path; paths that are not listed weigh 1.
MIX_WEIGHTS = {("d0",): 0.4, ("d1",): 0.3, ("d2",): 0.2, ("d3",): 0.1, **{(f"d{k}", "en"): 2.0 for k in range(4)}}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that three seeded epochs at most give to meet the weights,
    a row for each epoch."""
    docs = _table(spark, sf_dir, "documents").withColumn("domain", domain())
    levels = {"domain": F.col("domain"), "language": F.col("lang"), "source": F.col("source")}
    mixed = mixing.mix(docs, levels, budget_share=1.0, weights=MIX_WEIGHTS, max_epochs=3)
    return mixed.select("doc_id", "domain", "lang", "source", F.col("_mix_epoch").alias("epoch"), mixing.words().alias("n_tokens"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from the files."""
    path = common.new_path(spark, "token-store")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_documents(spark, path)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of all documents."""
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of
    all documents; the last is of the text rebuilt from output and form."""
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of all documents."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_packing": op4_packing,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality_rules": op6_quality_rules,
    "op7_topk": op7_topk,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_store": op9_token_store,
    "op10_mixing": op10_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_dedup": op13_exact_dedup,
}


def _quality_rules_sql(rules: quality_rules.DivergenceRules) -> str:
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '{c.replace(chr(39), chr(39) * 2)}+', '', 'g'))" for c in quality_rules.CLASSES)
    words = " ".join(f"WHEN '{lang}' THEN [" + ", ".join(f"(strlen(p) - strlen(replace(p, ' {w} ', ''))) // (strlen('{w}') + 2)" for w in listed) + "]" for lang, listed in rules.common_words.items())
    n_class, n_word = len(quality_rules.CLASSES) + 1, len(next(iter(rules.common_words.values()))) + 1
    share = lambda c, total: f"list_transform(list_append({c}, {total} - list_sum({c})), lambda x: x / greatest({total}, 1)::DOUBLE)"
    mean = lambda c, n, guard: "[" + ", ".join(f"avg({c}[{k + 1}]) FILTER ({guard})" for k in range(n)) + "]"
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} * 2 / ({a} + {b})) ELSE 0 END"
    js = lambda a, b, n: f"sqrt(greatest(list_sum(list_transform(range(1, {n + 1}), lambda i: {term(f'{a}[i]', f'{b}[i]')} + {term(f'{b}[i]', f'{a}[i]')})) / 2, 0))"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{quality_rules.SPACE}'), lambda x: x <> '') AS w,
    ' ' || regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', '  ', 'g') || ' ' AS p FROM documents),
lw AS (SELECT lang, list(w ORDER BY n DESC, w)[1:{n_word - 1}] AS listed FROM (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_filter(regexp_split_to_array(p, ' +'), lambda x: x <> '')) AS w
    FROM d WHERE lang IS NOT NULL AND lang NOT IN ({", ".join(f"'{x}'" for x in rules.common_words)})) GROUP BY 1, 2) GROUP BY lang),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (SELECT doc_id, i, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d))),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '{quality_rules.SYMBOLS}', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(r.n, 0) AS n_repeat_words, length(t) AS n_chars, [{counts}] AS cc,
    CASE lang {words} ELSE list_resize(list_transform(listed, lambda x: (strlen(p) - strlen(replace(p, ' ' || x || ' ', ''))) // (strlen(x) + 2)), {n_word - 1}, 0) END AS wc
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN lw USING (lang)),
s AS (SELECT *, {share("cc", "n_chars")} AS cs, {share("wc", "n_words")} AS ws FROM m),
f AS (SELECT lang, {mean("cs", n_class, f"n_chars >= {rules.min_chars}")} AS cr, {mean("ws", n_word, f"n_words >= {rules.min_words}")} AS wr FROM s WHERE lang IS NOT NULL GROUP BY lang),
j AS (SELECT s.*, CASE WHEN cr[1] IS NOT NULL THEN {js("cs", "cr", n_class)} END AS cd, CASE WHEN wr[1] IS NOT NULL THEN {js("ws", "wr", n_word)} END AS wd,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s LEFT JOIN f USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= {rules.min_chars} AND coalesce(cd > {rules.max_class_distance}, false)) AND NOT (n_words >= {rules.min_words} AND coalesce(wd > {rules.max_word_distance}, false)) AS kept
FROM j"""


#: SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op5_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x)
SELECT r.doc_id, min(r.c) AS class_id, coalesce(any_value(k.n), 0) AS n_links
FROM r LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = r.doc_id GROUP BY r.doc_id""",
    "op6_quality_rules": _quality_rules_sql(quality_rules.DivergenceRules()),
    "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
    "op8_substring_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE lo < doc_id),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM c)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
t AS (SELECT d.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || substring(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substring(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST('0x' || substring(h, 1, 8) AS BIGINT) % (len(w) + 1) AS x, CAST('0x' || substring(h, 9, 8) AS BIGINT) % (len(w) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, array_to_string(w[:least(x, y)], '') AS p, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(w[greatest(x, y) + 1:], '') AS s FROM c)
SELECT doc_id, len(w) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
    "op13_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
