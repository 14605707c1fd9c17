"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (class_lm, cotraining, decontam, divergence, langid, lexical, licenses, line_rules,
               mixing, perspectives, pii, simhash, token_files)
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: 150 % of their words, weights 3, 1, 2 by source."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of all documents by co-trained classifiers."""
    docs = table(spark, sf_dir, "documents")
    models = cotraining.fit(docs, table(spark, sf_dir, "labels"), ["quality", "toxic"])
    scores = cotraining.score(docs, models)
    good, toxic = F.col("quality_score") >= 0.5, F.col("toxic_score") >= 0.5
    return scores.select("*", good.alias("good_quality"), toxic.alias("toxic"),
                         (good & ~toxic).alias("kept"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents whose fingerprints are linked at 2 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of the line rules for all documents."""
    return line_rules.line_statistics(table(spark, sf_dir, "documents"), with_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_bad_lines", "lost_words")


def token_digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents by sentence rules."""
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"),
        F.array_join("sentences", ",").alias("sentences"), "n_unknown", "n_partial")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents to Simple-8b files and read them back."""
    return token_digest(token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-bigram and unigram log probabilities of all documents."""
    return class_lm.score_texts(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by rank-order profiles."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from the view of each participant, in parts of 1,024 turns."""
    return perspectives.rotate(table(spark, sf_dir, "conversations"), part_turns=1024).withColumn(
        "mask", perspectives.mask_text(F.col("mask")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside 10-word windows of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontam.contaminated_rows(docs, table(spark, sf_dir, "benchmark"), out="c")
    return hits.select("doc_id", "c.n_words", "c.n_hit",
                       F.size("c.items").cast("long").alias("n_items"),
                       decontam.items_digest(F.col("c.items")).alias("items_sha256"),
                       (F.col("c.n_hit") > 0).alias("contaminated"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item, by bag classes."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans, and those the classifier adds."""
    spans = F.col("spans")
    count = [F.size(pii.base_spans(spans, k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return pii.detect(table(spark, sf_dir, "documents")).select(
        "doc_id", *count, F.sha2(pii.listed(pii.base_spans(spans)), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of a language, and the terms behind it."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_quality, op3_simhash, op4_line_rules, op5_licenses, op6_token_files,
    op7_class_lm, op8_language_id, op9_perspectives, op10_decontamination,
    op11_lexical_search, op12_pii, op13_source_divergence)}

ORACLES: dict[str, str] = {
    "op1_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS sz,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, sum(2 * sz) OVER (ORDER BY 2 * sz / w, source ROWS UNBOUNDED PRECEDING)
            + 2 * sz / w * (sum(w) OVER () - sum(w) OVER (ORDER BY 2 * sz / w, source ROWS UNBOUNDED PRECEDING))
            <= 1.5 * sum(sz) OVER () AS is_full
  FROM s),
t AS (
  SELECT source, sz, least(2 * sz, round(CASE WHEN is_full THEN 2 * sz ELSE
           (1.5 * sum(sz) OVER () - sum(CASE WHEN is_full THEN 2 * sz ELSE 0 END) OVER ())
           / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () * w END, 6)) AS target
  FROM f),
c AS (
  SELECT d.*, sz, target, CASE WHEN sz > 0 THEN floor(target / sz) ELSE 0 END AS passes,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS unit
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, sz::BIGINT AS source_size, target,
       (size * (passes + CASE WHEN target - passes * sz > 0 AND upto - unit < target - passes * sz
                               AND 2 * upto - unit <= 2 * (target - passes * sz) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c""",
    "op4_line_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM d, unnest(generate_series(1, len(w) - 2)) u(i) WHERE len(w) > 2),
r AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g), (VALUES (0), (1), (2)) v(j)
  WHERE k > 1 GROUP BY doc_id),
l AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k,
         len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS solid,
         len(regexp_extract_all(line, '[!?]')) AS marks, len(regexp_extract_all(line, '[#*$%&<>]')) AS signs,
         len(regexp_extract_all(line, '[|»•]')) AS seps,
         regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           'accept all cookies|we use cookies|cookie policy|privacy policy|terms of service|terms of use|all rights reserved|enable javascript|click here|read more|sign up|log in|subscribe to our newsletter|share this|back to top|skip to content|follow us on|lorem ipsum') AS phrase
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
b AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup,
         count(*) FILTER (bad) AS bad, coalesce(sum(k) FILTER (bad), 0) AS lost
  FROM (SELECT *, 10 * marks > solid OR 10 * signs > solid OR seps >= 3 OR 2 * seps >= k
                  OR (k <= 40 AND phrase) AS bad FROM l WHERE k > 0)
  GROUP BY doc_id),
x AS (
  SELECT d.doc_id, len(w) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, coalesce(bad, 0) AS n_bad_lines, coalesce(lost, 0) AS lost_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN b USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= 30 * n_words AS kept,
       n_bad_lines::BIGINT AS n_bad_lines, lost_words::BIGINT AS lost_words
FROM x""",
    "op9_perspectives": """
WITH t AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 1024 AS part
  FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text, count(*) AS k FROM conversations GROUP BY ALL)),
v AS (
  SELECT t.*, s.role AS speaker,
         CASE WHEN t.role = s.role THEN '<|assistant|>' || chr(10)
              WHEN t.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || coalesce(t.role, 'unknown') || '|>' || chr(10) END AS head
  FROM t JOIN (SELECT DISTINCT conv_id, role FROM t WHERE role <> 'system') s
    ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (
  SELECT *, sum(length(head) + length(text) + 8) OVER (
           PARTITION BY conv_id, speaker ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop
  FROM v)
SELECT conv_id, speaker, part, sum(k)::BIGINT AS n_rows, count(*) AS n_turns,
       count(*) FILTER (role = speaker) AS n_own,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered,
       coalesce(string_agg((stop - length(text) - 8)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY turn, role, text)
         FILTER (role = speaker), '') AS mask
FROM p GROUP BY conv_id, speaker, part""",
    "op10_decontamination": r"""
WITH x AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) u(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM x, (SELECT DISTINCT n FROM bw) k, unnest(generate_series(1, len(w) - n + 1)) u(i) WHERE len(w) >= n),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit
        FROM h, unnest(generate_series(i, i + n - 1)) u(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT x.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM x LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_lexical_search": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT *, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS k FROM (
    SELECT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
f AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
g AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), s),
x AS (
  SELECT item_id, r, doc_id,
         sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * docs) // total)))))::BIGINT AS score
  FROM f JOIN q USING (term) JOIN g USING (term), s GROUP BY ALL),
o AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total
      FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
x AS (
  SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM s JOIN k ON s.lang = k.lang JOIN v ON v.lang = s.lang
  LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
y AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL)
  JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM c GROUP BY lang) USING (lang) JOIN v USING (lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT x.lang, x.source, 'term', x.term, (((p - q) * (p - q)) // q)::BIGINT
  FROM x JOIN y ON x.lang = y.lang AND x.term = y.term WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
WHERE part = 'pair' OR rank <= 200""",
}
