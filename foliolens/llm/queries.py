"""Registered queries of these operators: ``{name: (function of (spark, folder), SQL or None)}``."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.llm import collocations, decontamination, extraction, language, lexical, line_dedup, mixing, nearest, sharding, simhash, suffix_dedup, token_files, toxicity
from foliolens.llm.common import remainder, small_batches, table
from foliolens.plans.reuse import new_folder


def op1_line_dedup(spark, folder):
    kept = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.md5("kept_text").alias("kept_md5")
    )


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS p
  FROM documents),
windows AS (
  SELECT doc_id, p, l || chr(10) || lead(l, 1) OVER d || chr(10) || lead(l, 2) OVER d AS g
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS nth FROM windows WHERE g IS NOT NULL),
covered AS (
  SELECT DISTINCT doc_id, p + o AS p, 1 AS c FROM ranked, (SELECT unnest([0, 1, 2]) AS o) WHERE nth > 1),
marked AS (
  SELECT doc_id, p, l, coalesce(c, 0) AS c, coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY p), 0) AS before
  FROM lines LEFT JOIN covered USING (doc_id, p)),
docs AS (
  SELECT doc_id, count(*) AS n_lines, sum(c) AS n_removed, sum(CASE WHEN c = 1 AND before = 0 THEN 1 ELSE 0 END) AS n_spans,
    md5(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (c = 0), '')) AS kept_md5
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, kept_md5
FROM documents LEFT JOIN docs USING (doc_id)
"""


def toxicity_model(docs, labels):
    """Fitted on the rows whose labels may teach."""
    return toxicity.fit_toxicity(docs.filter(remainder("doc_id", 3) != 1), labels)


def op2_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity_model(docs, table(spark, folder, "labels"))
    scored = small_batches(docs).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), toxicity.toxicity_score(model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op3_language(spark, folder):
    docs = table(spark, folder, "documents")
    model = language.fit_languages(docs.filter(remainder("doc_id", 4) != 2))
    return language.languages(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_suffix_dedup(spark, folder):
    kept = suffix_dedup.dedup_substrings(table(spark, folder, "documents"))
    return kept.select(F.col("k").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH data AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS s FROM data),
windows AS (SELECT doc_id, s, md5(b[s:s + 99]) AS w FROM starts),
again AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
begun AS (SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 100, TRUE)::INT AS new FROM again),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM begun),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 99 AS z FROM numbered GROUP BY doc_id, span),
before AS (
  SELECT doc_id, span, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY span), 0) AS kept_after FROM spans),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed, max(z) AS last,
    string_agg(CASE WHEN a - kept_after > 1 THEN hex(b[kept_after + 1:a - 1]) ELSE '' END, '' ORDER BY span) AS kept
  FROM before JOIN data USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b WHEN last >= octet_length(b) THEN unhex(kept)
              ELSE unhex(kept || hex(b[last + 1:octet_length(b)])) END) AS kept_sha256
FROM data LEFT JOIN cut USING (doc_id)
"""


def op5_extraction(spark, folder):
    pages = table(spark, folder, "pages")
    found = small_batches(pages).select("page_id", "url", extraction.extracted(extraction.fit(pages)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_mixing(spark, folder):
    mixed = mixing.mix_sizes(table(spark, folder, "documents"))
    return mixed.select(F.col("k").alias("doc_id"), "size", "source_size", "target", "taken", "source", "shard", "place")


def op7_nearest(spark, folder):
    return nearest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_decontamination(spark, folder):
    pairs = decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return pairs.select(F.col("k").alias("doc_id"), F.col("item").alias("item_id"), "edits", "words")


def op9_simhash(spark, folder):
    groups = simhash.simhash_groups(table(spark, folder, "documents"))
    return groups.select(
        F.col("k").alias("doc_id"),
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_sharding(spark, folder):
    rows = sharding.shard_rows(table(spark, folder, "documents"))
    return rows.select(
        F.col("k").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op11_lexical(spark, folder):
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, rowid_ AS d, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid_ FROM documents)),
tfs AS (SELECT d, doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT d, sum(tf)::BIGINT AS n FROM tfs GROUP BY d),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
weights AS (
  SELECT t, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, corpus GROUP BY t, docs),
scores AS (
  SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM terms JOIN tfs USING (t) JOIN weights USING (t) JOIN lengths USING (d), corpus GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""


#: Vocabulary of the installed tokenizer files.
VOCABULARY = "byte_bpe_50k.json"


def op12_token_files(spark, folder):
    import public_tokenizers

    path = new_folder(spark)
    token_files.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path(VOCABULARY))
    return token_files.token_digests(spark, path)


def op13_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(p) AS piece, unnest(range(len(p))) AS nr
  FROM (SELECT lang, doc_id, regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m AS k, count(*) AS f
  FROM placed, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
size AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidate AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 100),
cuts AS (
  SELECT lang, phrase, k, a, c, array_to_string(w[1:c], ' ') AS p, array_to_string(w[c + 1:k], ' ') AS q
  FROM candidate, (SELECT unnest([1, 2, 3, 4]) AS c) WHERE c < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, c, lp.f AS l, rp.f AS r, n,
    ((1000::HUGEINT * a * n) // (lp.f::HUGEINT * rp.f))::BIGINT AS score
  FROM cuts JOIN grams lp ON lp.lang = cuts.lang AND lp.phrase = p JOIN grams rp ON rp.lang = cuts.lang AND rp.phrase = q
  JOIN size ON size.lang = cuts.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM candidate, (SELECT unnest([2, 3, 4]) AS m), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (
  SELECT worst.* FROM worst LEFT JOIN inside ON inside.lang = worst.lang AND inside.phrase = worst.phrase
  WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


QUERIES = {
    "op1_line_dedup": (op1_line_dedup, OP1_SQL),
    "op2_toxicity": (op2_toxicity, None),
    "op3_language": (op3_language, None),
    "op4_suffix_dedup": (op4_suffix_dedup, OP4_SQL),
    "op5_extraction": (op5_extraction, None),
    "op6_mixing": (op6_mixing, None),
    "op7_nearest": (op7_nearest, None),
    "op8_decontamination": (op8_decontamination, None),
    "op9_simhash": (op9_simhash, None),
    "op10_sharding": (op10_sharding, None),
    "op11_lexical": (op11_lexical, OP11_SQL),
    "op12_token_files": (op12_token_files, None),
    "op13_collocations": (op13_collocations, OP13_SQL),
}
