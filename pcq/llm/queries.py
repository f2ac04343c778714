"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, idfiles, langid, merkle, mixing, packing, pitman_yor, simhash, suffix, toxicity, urlfilter, vectorcodes
from .common import Scratch, crc_mod, table


def tokenizer_path() -> str:
    """The vocabulary file of a public tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    # Short rows; while they are few, texts are not moved to meet them.
    labels = F.broadcast(labels) if labels.count() <= toxicity.BROADCAST_LABELS else labels
    model = toxicity.fit(docs.join(labels, "doc_id"))
    return toxicity.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'op6').root}/ids"
    idfiles.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return idfiles.digest(idfiles.read(spark, path))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "passes")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) != 0)


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    # Entries are below 256: of the two bytes of an index, the first.
    code = F.regexp_replace(F.lower(F.hex("code")), "(..)..", "$1")
    return vectorcodes.label_errors(codes.rows).select("vec_id", code.alias("code"), "error", "label_error", F.lit(codes.books_sha256()).alias("codebooks_sha256"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = idfiles.tokenise(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return packing.pack(packing.pieces(ids, with_ids=False).drop("ids"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_mod(F.col("doc_id"), 3) == 0, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    claim = merkle.leaf([tampered if c == "text" else F.col(c) for c in merkle.DOCUMENT])
    folded = merkle.folded(F.col("path"), F.col("claim"))
    proofs = merkle.build(docs, claim=claim).proofs().select("*", merkle.digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op1_nearest_neighbours": op1_nearest_neighbours, "op2_url_filter": op2_url_filter, "op3_toxicity": op3_toxicity, "op4_benchmark_decontamination": op4_benchmark_decontamination, "op6_token_id_output": op6_token_id_output, "op5_simhash_near_dedup": op5_simhash_near_dedup, "op7_suffix_array_dedup": op7_suffix_array_dedup, "op8_source_mixing": op8_source_mixing, "op9_language_id": op9_language_id, "op10_lm_scoring": op10_lm_scoring, "op11_vector_code_compression": op11_vector_code_compression, "op12_best_fit_packing": op12_best_fit_packing, "op13_merkle_manifest": op13_merkle_manifest}

ORACLES = {
    "op4_benchmark_decontamination": """
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT doc_id, len(w) AS words, greatest(len(w) - 4, 1) AS n, unnest(range(greatest(len(w) - 4, 1))) AS pos, w FROM dw WHERE len(w) > 0
), dsh AS (SELECT doc_id, words, n, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS s FROM ds
), ish AS (
  SELECT item_id, words, n, s, count(*) AS c FROM (
    SELECT item_id, len(w) AS words, greatest(len(w) - 4, 1) AS n, w, unnest(range(greatest(len(w) - 4, 1))) AS pos FROM iw WHERE len(w) > 0
  ) t, LATERAL (SELECT array_to_string(w[pos + 1 : pos + 5], ' ') AS s) GROUP BY ALL
), hits AS (
  SELECT d.doc_id, i.item_id, i.n, i.words, d.n AS dn, greatest(d.words - i.words, 0) AS last, d.pos, d.s, i.c FROM dsh d JOIN ish i USING (s)
), starts AS (
  SELECT DISTINCT doc_id, item_id, n, words, dn, unnest(range(greatest(pos - n + 1, 0), least(pos, last) + 1)) AS start FROM hits
), shared AS (
  SELECT s.doc_id, s.item_id, s.start, s.n, s.words, s.dn, h.s, least(count(*), any_value(h.c)) AS m
  FROM starts s JOIN hits h ON s.doc_id = h.doc_id AND s.item_id = h.item_id AND h.pos BETWEEN s.start AND s.start + s.n - 1 GROUP BY ALL
), sims AS (
  SELECT doc_id, item_id, start, words, CAST(sum(m) AS DOUBLE) / CAST(least(n, dn - start) + n - sum(m) AS DOUBLE) AS similarity
  FROM shared GROUP BY doc_id, item_id, start, n, words, dn
)
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start, CAST(words AS INTEGER) AS n_words FROM sims WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
""",
    "op8_source_mixing": """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w
  FROM d GROUP BY source
), p AS (
  SELECT source, source_size, w, 2e0 * source_size AS cap,
         sum(2e0 * source_size) OVER o - 2e0 * source_size AS caps_before, sum(w) OVER () - sum(w) OVER o + w AS w_left,
         1.5e0 * sum(source_size) OVER () AS budget, 2e0 * source_size / w AS ratio
  FROM s WINDOW o AS (ORDER BY 2e0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), lvl AS (SELECT max((budget - caps_before) / w_left) FILTER (WHERE (budget - caps_before) / w_left <= ratio) AS level FROM p),
t AS (SELECT source, source_size, least(cap, w * level) AS target FROM p, lvl),
u AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), r AS (
  SELECT doc_id, source, size, source_size, target, whole, h,
         sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY source, h) AS tie
  FROM d JOIN u USING (source)
), q AS (
  SELECT *, CAST(whole + CASE WHEN target - whole * source_size > 0 AND upto - tie + tie / 2e0 <= target - whole * source_size THEN 1 ELSE 0 END AS BIGINT) AS passes FROM r
)
SELECT doc_id, size, source_size, target, CAST(passes * size AS BIGINT) AS taken, source, passes FROM q
""",
    "op11_vector_code_compression": """
WITH p AS (
  SELECT vec_id, label, part, q[4 * part + 1] AS a, q[4 * part + 2] AS b, q[4 * part + 3] AS c, q[4 * part + 4] AS d FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ), (SELECT unnest(range(16)) AS part)
), b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, a, b, c, d FROM p QUALIFY e < 64
), a1 AS (
  SELECT p.vec_id, p.part, min(((p.a - e.a) ** 2 + (p.b - e.b) ** 2 + (p.c - e.c) ** 2 + (p.d - e.d) ** 2)::BIGINT * 64 + e.e) AS m FROM p JOIN b0 e USING (part) GROUP BY ALL
), s1 AS (
  SELECT part, m % 64 AS e, count(*) AS n, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d FROM p JOIN a1 USING (vec_id, part) GROUP BY ALL
), b1 AS (
  SELECT o.part, o.e, coalesce((s.a - (s.a % n + n) % n) // n, o.a) AS a, coalesce((s.b - (s.b % n + n) % n) // n, o.b) AS b,
         coalesce((s.c - (s.c % n + n) % n) // n, o.c) AS c, coalesce((s.d - (s.d % n + n) % n) // n, o.d) AS d
  FROM b0 o LEFT JOIN s1 s ON o.part = s.part AND o.e = s.e
), a2 AS (
  SELECT p.vec_id, p.part, min(((p.a - e.a) ** 2 + (p.b - e.b) ** 2 + (p.c - e.c) ** 2 + (p.d - e.d) ** 2)::BIGINT * 64 + e.e) AS m FROM p JOIN b1 e USING (part) GROUP BY ALL
), s2 AS (
  SELECT part, m % 64 AS e, count(*) AS n, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d FROM p JOIN a2 USING (vec_id, part) GROUP BY ALL
), b2 AS (
  SELECT o.part, o.e, coalesce((s.a - (s.a % n + n) % n) // n, o.a) AS a, coalesce((s.b - (s.b % n + n) % n) // n, o.b) AS b,
         coalesce((s.c - (s.c % n + n) % n) // n, o.c) AS c, coalesce((s.d - (s.d % n + n) % n) // n, o.d) AS d
  FROM b1 o LEFT JOIN s2 s ON o.part = s.part AND o.e = s.e
), a3 AS (
  SELECT p.vec_id, any_value(p.label) AS label, p.part, min(((p.a - e.a) ** 2 + (p.b - e.b) ** 2 + (p.c - e.c) ** 2 + (p.d - e.d) ** 2)::BIGINT * 64 + e.e) AS m
  FROM p JOIN b2 e USING (part) GROUP BY p.vec_id, p.part
), r AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a3 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256
FROM r
""",
    "op13_merkle_manifest": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, list_reduce(
    list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)), 4294967295) AS crc
  FROM documents
), h AS (
  SELECT doc_id, lang, xor(crc, 4294967295) % 3 = 0 AS changed,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS own,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS other
  FROM d
), l AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
         sha256(head || own) AS leaf, sha256(head || CASE WHEN changed THEN other ELSE own END) AS claim
  FROM h
), node AS (
  SELECT lang, 0 AS k, idx, n, leaf AS digest FROM l
  UNION ALL
  SELECT lang, k + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY lang, k, idx // 8, n
), tops AS (
  SELECT lang, k AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1
), high AS (
  SELECT 0 AS k, idx, n, subroot AS digest FROM tops
  UNION ALL
  SELECT k + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY k, idx // 8, n
), beside AS (
  SELECT a.lang, a.k, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
  FROM node a JOIN node b ON a.lang IS NOT DISTINCT FROM b.lang AND a.k = b.k AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.lang, a.k, a.idx
), above AS (
  SELECT a.k, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
  FROM high a JOIN high b ON a.k = b.k AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.k, a.idx
), step AS (
  SELECT l.doc_id, b.k AS nth, lft, rgt FROM l JOIN beside b ON l.lang IS NOT DISTINCT FROM b.lang AND l.idx >> (3 * b.k) = b.idx
  UNION ALL
  SELECT l.doc_id, t.height + a.k, lft, rgt FROM l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang JOIN above a ON t.idx >> (3 * a.k) = a.idx
), fold AS (
  SELECT doc_id, 0 AS nth, claim AS digest FROM l
  UNION ALL
  SELECT f.doc_id, f.nth + 1, sha256(s.lft || f.digest || s.rgt) FROM fold f JOIN step s ON f.doc_id = s.doc_id AND f.nth = s.nth
), proof AS (SELECT doc_id, sha256(string_agg(lft || rgt, '' ORDER BY nth)) AS proof_sha256 FROM step GROUP BY doc_id),
last AS (SELECT doc_id, arg_max(digest, nth) AS folded_root FROM fold GROUP BY doc_id)
SELECT l.doc_id, l.leaf, t.subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang JOIN last USING (doc_id) LEFT JOIN proof p USING (doc_id), (SELECT digest FROM high WHERE n = 1) r
""",
}
