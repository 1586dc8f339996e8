"""The numbered queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm import contamination, language, lexical, licenses, linefreq, minhash, neurallm, pagetext, periodic, pieces, quality, tokenbin, warc
from weekloom.llm.tables import crc_remainder, read_table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def held_out_language() -> F.Column:
    return F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), prior=200_000)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = language.fit_profiles(docs.where(~held_out_language()))
    return language.identify(docs, profiles).select("doc_id", held_out_language().alias("held_out"), "lang_pred", "score")


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_pieces(docs, PIECE_MODEL)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), F.length("decoded").cast("long").alias("decoded_chars"))


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return warc.read_back(pages, warc.write_index(warc.write_archives(pages)), strict=True)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read_tokens(tokenbin.write_tokens(read_table(spark, sf_dir, "documents"), BYTE_VOCABULARY))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"), licenses.TEMPLATES | licenses.whole_templates())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.col("text").alias("before"))
    out = linefreq.drop_boilerplate(docs)
    lines = F.size(F.split("before", "\n")) - F.when(F.col("text") == "", F.when(F.col("before") == "", 1).otherwise(0)).otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", lines.cast("long").alias("n_dropped"), F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neurallm.lm_scores(read_table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page; null or empty html gives an empty text."""
    pages = pagetext.main_text(read_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id and score of the ten best documents of every benchmark item."""
    return lexical.lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), top=10)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest run of every document and digests of all its runs and its collapsed text; the contract repeats words in a tenth of the documents first."""
    found = periodic.periodic_runs(periodic.with_planted_runs(read_table(spark, sf_dir, "documents")))
    best, lines = F.col("best"), F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("best", periodic.strongest("runs")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_near_duplicates, op3_language_id, op4_piece_encoding, op5_contamination, op6_warc, op7_token_files, op8_license_scan, op9_line_dedup, op10_lm_scores, op11_main_text, op12_lexical_search, op13_periodic_runs)}


_TRIMMED = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

_LINE_DEDUP = f"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
texts AS (SELECT DISTINCT source, text, lines FROM pages),
totals AS (SELECT source, count(*) AS pages FROM texts GROUP BY source),
each AS (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: {_TRIMMED}))) AS line FROM texts),
counts AS (SELECT source, line, count(*) AS n FROM each WHERE line <> '' GROUP BY source, line),
often AS (SELECT c.source, list(c.line) AS often FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
          WHERE c.n >= 3 AND c.n > 0.01 * t.pages GROUP BY c.source),
kept AS (SELECT doc_id, text, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(often, []), {_TRIMMED})) AS left_lines
         FROM pages p LEFT JOIN often o ON p.source IS NOT DISTINCT FROM o.source),
done AS (SELECT doc_id, lines, left_lines, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(left_lines, chr(10)), '') END AS out FROM kept)
SELECT doc_id, CAST(len(lines) - len(left_lines) AS BIGINT) AS n_dropped, CAST(length(out) AS BIGINT) AS n_chars_left, md5(out) AS text_md5 FROM done
"""

_TOKENS = """
SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
"""

_NEAR_DUPLICATES = f"""
WITH RECURSIVE tokens AS ({_TOKENS}),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM tokens),
one AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN sides l ON r.b = l.a),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_id ON a = doc_id
"""


_LEXICAL_SEARCH = """
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
asked AS (SELECT item_id, t, count(*) AS repeats FROM (SELECT item_id, unnest(w) AS t FROM items) GROUP BY item_id, t),
totals AS (SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM docs WHERE len(w) > 0),
tfs AS (SELECT row, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY row, t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * N + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tfs, totals GROUP BY t, N),
parts AS (SELECT tfs.row, docs.doc_id, tfs.t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * CAST(len(w) AS BIGINT) * N) // L)))) AS part
          FROM tfs JOIN docs ON docs.row = tfs.row JOIN weights ON weights.t = tfs.t, totals),
scores AS (SELECT item_id, row, doc_id, CAST(sum(repeats * part) AS BIGINT) AS score FROM asked JOIN parts ON asked.t = parts.t GROUP BY item_id, row, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_lexical_search": _LEXICAL_SEARCH, "op2_near_duplicates": _NEAR_DUPLICATES, "op9_line_dedup": _LINE_DEDUP}
