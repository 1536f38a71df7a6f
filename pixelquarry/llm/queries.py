"""Registered queries of the training-data operators: whole tables in, whole results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, hnsw, jaccard_join, masked_lm, merkle, packing, piece_transducer, quality, secret_scan, substring_dedup, token_counts, topk_search, warc
from .shared import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup.digest(substring_dedup.dedup_substrings(docs))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_from_pages(documents(spark, sf_dir, "pages")))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_products(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.scored(documents(spark, sf_dir))


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text", "source"))


def op6_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.round_trip(documents(spark, sf_dir).select("doc_id", "text"), packing.tokenizer_path("piece_bpe_32k.model"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.learn(docs)))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.classify(docs, documents(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_tampered(documents(spark, sf_dir).select(*merkle.FIELDS))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.digest(token_counts.token_counts(docs, packing.tokenizer_path("piece_bpe_32k.model")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dropped = conversation_repair.damaged(documents(spark, sf_dir, "conversations"))
    return conversation_repair.summary(rows, dropped=dropped)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op3_topk_search": OP3, "op9_jaccard_join": OP9, "op11_merkle_manifest": OP11, "op13_conversation_repair": OP13}


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit: each byte is followed by eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: list_prepend(CAST(ascii(c) AS BIGINT), repeat([CAST(-1 AS BIGINT)], 8))))"
    step = "CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda x, y: {step}), CAST(4294967295 AS BIGINT))"


OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT rid, i, list_slice(w, i, i + 34) AS k FROM d, unnest(range(1, len(w) - 33)) AS t(i)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1
), gone AS (
  SELECT DISTINCT rid, i + j AS p FROM rep, unnest(range(0, 35)) AS t(j)
), word AS (
  SELECT rid, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)
), kept AS (
  SELECT rid, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid
), cut AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN cut USING (rid)
"""

OP9 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT rid, list_slice(w, i, i + 4) AS g
  FROM d, unnest(range(1, greatest(len(w) - 3, CAST(len(w) > 0 AS INT) + 1))) AS t(i)
), n AS (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), links AS (
  SELECT a.rid AS x, b.rid AS y
  FROM s AS a JOIN s AS b ON a.g = b.g AND a.rid <> b.rid JOIN n AS p ON p.rid = a.rid JOIN n AS q ON q.rid = b.rid
  WHERE 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  GROUP BY a.rid, b.rid, p.n, q.n
  HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (
  SELECT rid, rid AS other FROM d
  UNION
  SELECT r.rid, l.y FROM reach AS r JOIN links AS l ON l.x = r.other
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) JOIN reach USING (rid) JOIN d AS o ON o.rid = reach.other
GROUP BY d.rid, d.doc_id, n.n
"""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(text: str) -> str:
    fields = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


OP11 = f"""
WITH RECURSIVE leaf AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS now
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM leaf
), node AS (
  SELECT lang, 0 AS level, r, n, leaf AS h FROM ranked
  UNION ALL
  SELECT lang, level + 1, r // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY r)) FROM node WHERE n > 1 GROUP BY lang, level, r // 8, n
), sub AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM node WHERE n = 1
), top AS (
  SELECT 0 AS level, r, n, h FROM sub
  UNION ALL
  SELECT level + 1, r // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY r)) FROM top WHERE n > 1 GROUP BY level, r // 8, n
), low AS (
  SELECT rid, lang, 0 AS level, r, n, now AS cur, '' AS sibs FROM ranked
  UNION ALL
  SELECT f.rid, f.lang, f.level + 1, f.r // 8, (f.n + 7) // 8, sha256(string_agg(CASE WHEN c.r = f.r THEN f.cur ELSE c.h END, '' ORDER BY c.r)),
         f.sibs || coalesce(string_agg(c.h, '' ORDER BY c.r) FILTER (c.r <> f.r), '')
  FROM low AS f JOIN node AS c ON c.lang IS NOT DISTINCT FROM f.lang AND c.level = f.level AND c.r // 8 = f.r // 8
  WHERE f.n > 1 GROUP BY f.rid, f.lang, f.level, f.r, f.n, f.cur, f.sibs
), high AS (
  SELECT l.rid, 0 AS level, s.r, s.n, l.cur, l.sibs FROM low AS l JOIN sub AS s ON s.lang IS NOT DISTINCT FROM l.lang WHERE l.n = 1
  UNION ALL
  SELECT f.rid, f.level + 1, f.r // 8, (f.n + 7) // 8, sha256(string_agg(CASE WHEN c.r = f.r THEN f.cur ELSE c.h END, '' ORDER BY c.r)),
         f.sibs || coalesce(string_agg(c.h, '' ORDER BY c.r) FILTER (c.r <> f.r), '')
  FROM high AS f JOIN top AS c ON c.level = f.level AND c.r // 8 = f.r // 8
  WHERE f.n > 1 GROUP BY f.rid, f.level, f.r, f.n, f.cur, f.sibs
)
SELECT k.doc_id, k.leaf, s.h AS subroot, t.h AS root, sha256(f.sibs) AS proof_sha256, f.cur AS folded_root, f.cur = t.h AS verified
FROM ranked AS k JOIN sub AS s ON s.lang IS NOT DISTINCT FROM k.lang JOIN high AS f ON f.rid = k.rid AND f.n = 1 JOIN top AS t ON t.n = 1
"""

OP13 = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS damage
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, unnest(range(0, CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS i,
         NOT regexp_matches(text, '[^ 	-
]') AS blank, right(regexp_replace(text, '[ 	-
]+$', ''), 1) NOT IN ('.', '!', '?') AS cut
  FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS c, CASE WHEN blank THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN cut THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM numbered
), inserted(place, n, mid, made) AS (
  VALUES ('', 0, '', []), ('', 1, 'u', ['user:']), ('', 2, 'a', ['user:', 'assistant:']), ('s', 0, 's', []), ('s', 1, 'u', ['user:']), ('s', 2, 'a', ['user:', 'assistant:']),
         ('u', 0, 'u', []), ('u', 1, 'a', ['assistant:']), ('u', 2, 'u', ['assistant:', 'user:']), ('a', 0, 'a', []), ('a', 1, 'u', ['user:']), ('a', 2, 'a', ['user:', 'assistant:'])
), kept(mid, c) AS (
  VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')
), moved AS (
  SELECT place, n, mid, made, 'K' AS op, c FROM inserted JOIN kept USING (mid)
  UNION ALL
  SELECT place, n, mid, made, op, NULL FROM inserted, unnest(['D', 'R']) AS t(op)
), best AS (
  SELECT conv_id, 0 AS i, '' AS place, {{'cost': 0, 'audit': '', 'made': CAST([] AS VARCHAR[])}} AS b FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, place, min(b) FROM (
    SELECT p.conv_id, p.i + 1 AS i, CASE m.op WHEN 'D' THEN m.mid WHEN 'K' THEN m.c ELSE CASE m.mid WHEN 'u' THEN 'a' ELSE 'u' END END AS place,
           {{'cost': p.b.cost + 2 * m.n + CASE m.op WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + CAST(m.op <> 'D' AND j.fault = 'truncated' AS INT),
             'audit': p.b.audit || repeat('I', m.n) || m.op,
             'made': p.b.made || m.made || CASE m.op WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [CASE m.mid WHEN 'u' THEN 'assistant:' ELSE 'user:' END || j.text] END}} AS b
    FROM best AS p JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1 JOIN moved AS m ON m.place = p.place
    WHERE (m.op = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (m.op <> 'K' OR m.c = j.c)
  ) GROUP BY conv_id, i, place
), stats AS (
  SELECT o.conv_id, count(j.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY o.conv_id
), ended AS (
  SELECT s.conv_id, min({{'cost': b.cost + 2 * m.n, 'audit': b.audit || repeat('I', m.n), 'made': b.made || m.made}}) AS e
  FROM stats AS s JOIN best AS p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.i = s.n JOIN inserted AS m ON m.place = p.place AND m.mid IN ('', 'a')
  GROUP BY s.conv_id
)
SELECT s.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(e.cost AS BIGINT) AS cost, e.audit AS audit, sha256(array_to_string(e.made, chr(10))) AS repaired_sha256
FROM stats AS s JOIN ended AS d ON d.conv_id IS NOT DISTINCT FROM s.conv_id
"""
