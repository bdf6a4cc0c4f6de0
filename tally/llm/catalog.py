"""Registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

import zlib

from tally.llm import (
    collision_search,
    embedding_dedup,
    html_extract,
    lexical_search,
    minhash_dedup,
    mixing,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    toxicity,
    warc,
)
from tally.llm.common import table

#: The tokenizer's file: a parameter of packing.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("mix_key")


def op9_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def planted_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op11's documents: every tenth document (by the checksum of its id) goes round from some word on."""
    if doc_id is None or not words:
        return words
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(len(words) - a)]


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.digest(periodic_runs.find_runs(table(spark, sf_dir, "documents"), prepare=planted_words))


def op12_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collision_search(spark, sf_dir):
    return collision_search.search(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    own = (
        op1_toxicity,
        op2_quality_rules,
        op3_embedding_dedup,
        op4_quality_classifier,
        op5_minhash_dedup,
        op6_suffix_dedup,
        op7_warc,
        op8_mixing,
        op9_html_extract,
        op10_packing,
        op11_periodic_runs,
        op12_lexical_search,
        op13_collision_search,
    )
    return {f.__name__: f for f in own}


OP8_SQL = """
WITH sizes AS (
  SELECT coalesce(source, '') AS s, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY 1
), weighed AS (SELECT s, size, CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0 END AS weight FROM sizes),
rates AS (
  SELECT s, CASE WHEN size > 0 THEN round(weight / sum(weight) OVER () * sum(size) OVER () * 1.0 / size, 9) ELSE 0 END AS rate
  FROM weighed
), drawn AS (
  SELECT d.*, r.rate,
    CAST(('0x' || substr(md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON r.s = coalesce(d.source, '')
), terms AS (
  SELECT s, range AS k, CAST(exp(-rate) * pow(rate, range) / gamma(range + 1) AS DOUBLE) AS p FROM rates, range(0, 60) WHERE rate > 0
), cdf AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
    (SELECT count(*) FROM cdf WHERE cdf.s = coalesce(d.source, '') AND cdf.c <= d.u) AS n
  FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(n)) AS INTEGER) AS copy_no FROM counted WHERE n > 0
"""


OP11_SQL = r"""
WITH hashed AS (
  SELECT doc_id, text,
    xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
      lambda crc, b: xor(xor(crc, b) >> 1, CASE WHEN xor(crc, b) % 2 = 1 THEN 3988292384 ELSE 0 END)
    ), 4294967295) AS h
  FROM documents
), split AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM hashed
), tail AS (
  SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN g % len(ws) END AS a FROM split
), step AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM tail),
numbered AS (
  SELECT doc_id, n, h, a, p, ws, unnest(range(n)) AS i FROM step WHERE n > 0
), words AS (
  SELECT doc_id, n, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM numbered
), same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i
  WHERE y.i - x.i <= x.n // 4
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same
), stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM stretches r WHERE NOT EXISTS (
    SELECT 1 FROM stretches o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.len >= r.s + r.len)
), per_doc AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    first(s ORDER BY len DESC, s, q) AS start, first(len ORDER BY len DESC, s, q) AS length, first(q ORDER BY len DESC, s, q) AS period
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per_doc USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP12_SQL = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL
), held AS (SELECT row, doc_id, ts, len(ts) AS n FROM doc_terms WHERE len(ts) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM held),
item_terms AS (
  SELECT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), asked AS (SELECT item_id, t, count(*) AS repeats FROM item_terms GROUP BY ALL),
exploded AS (SELECT row, unnest(ts) AS t FROM held),
postings AS (SELECT row, t, count(*) AS tf FROM exploded SEMI JOIN asked USING (t) GROUP BY ALL),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM postings GROUP BY t), corpus
), impacts AS (
  SELECT p.t, h.doc_id, h.row, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS impact
  FROM postings p JOIN held h USING (row) JOIN weights USING (t), corpus
), scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (t) GROUP BY item_id, row, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


OP13_SQL = """
WITH vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_prepend(0.0::DOUBLE, [(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q.e, v.e)]), lambda a, b: a + b)) AS score
  FROM vectors q JOIN vectors v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict:
    return {"op8_mixing": OP8_SQL, "op11_periodic_runs": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_collision_search": OP13_SQL}
