"""The operators as registered queries with production parameters, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from caudal.llm import language_id, sentencepieces
from caudal.llm.common import table
from caudal.llm.embedding_dedup import near_embeddings
from caudal.llm.exact_dedup import exact_duplicates
from caudal.llm.html_text import extract_main_text
from caudal.llm.line_dedup import near_equal_lines
from caudal.llm.merkle import leaf_digest, manifest
from caudal.llm.minhash_dedup import near_duplicates
from caudal.llm.nearest import nearest_neighbours
from caudal.llm.packing import WORD_BPE, pack
from caudal.llm.periodic_runs import periodic_runs, repeating_tail
from caudal.llm.pii import find_personal_data, span_text
from caudal.llm.url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# Fixed values of the task.
URL_RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
    ("com/fr/", "allow"), ("com/de/", "block"),
)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules).drop("trust", "distrust")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select(
        "doc_id", language_id.held_out_fold(F.col("doc_id")).alias("held_out"),
        "lang_pred", "score",
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        span_text(F.col("all_spans")).alias("spans"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to ids and back: what came out, and whether it is the text again."""
    model = public_tokenizers.path(sentencepieces.PIECE_BPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepieces.encode_and_decode(docs, model)
    ids = F.array_join("piece_ids", ",")
    return back.select(
        "doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_equal_lines(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)).drop("ids")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", repeating_tail(F.col("doc_id"), F.col("text")).alias("text")
    )
    listed = F.transform(
        "runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    )
    # Greatest length, then smallest start and period.
    ranked = F.array_max(F.transform(
        "runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
    ))
    found = periodic_runs(docs).withColumn("longest", ranked)
    length, period = F.col("longest.n"), -F.col("longest.p")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", capitals, capitals.lower())
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    made = manifest(
        docs, id_col="doc_id", group_col="lang", leaf=leaf_digest(*fields, F.col("text")),
        changed=F.when(tampered, leaf_digest(*fields, lowered)),
    )
    folded = F.element_at("path", -1)
    return made.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_nearest": op1_nearest,
        "op2_url_filter": op2_url_filter,
        "op3_language_id": op3_language_id,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_html_text": op5_html_text,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_pii": op7_pii,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_line_dedup": op9_line_dedup,
        "op10_packing": op10_packing,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_merkle": op12_merkle,
        "op13_embedding_dedup": op13_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": URL_FILTER, "op4_exact_dedup": EXACT_DEDUP, "op6_minhash_dedup": NEAR_DEDUP, "op12_merkle": MERKLE,
        "op13_embedding_dedup": NEAR_EMBEDDINGS,
    }


# Ranks as the sum of 300 steps of the walk, scaled to the seeds; 0.85^300 is below 1e-21.
URL_FILTER = rf"""
WITH RECURSIVE rules(rule, verdict) AS (
  VALUES {", ".join(map(str, URL_RULES))}
), addresses AS (
  SELECT page_id, html,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages)
), fits AS (
  SELECT DISTINCT host, path, rule, verdict
  FROM addresses JOIN rules
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
   AND starts_with(path, substr(rule, strpos(rule, '/')))
), best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM fits GROUP BY host, path
), named AS (
  SELECT host AS src,
         translate(unnest(regexp_extract_all(coalesce(html, ''),
           '(?i)href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM addresses
), links AS (
  SELECT src, dst, count(*) AS weight FROM named WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), directed AS (
  SELECT 'allow' AS kind, src, dst, weight FROM links
  UNION ALL
  SELECT 'block', dst, src, weight FROM links
), shares AS (
  SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM directed
), seeds AS (
  SELECT verdict AS kind, host, count(*)::DOUBLE AS seed
  FROM addresses JOIN best USING (host, path) WHERE host <> '' GROUP BY verdict, host
), walk AS (
  SELECT kind, 0 AS step, host, seed AS came FROM seeds
  UNION ALL
  SELECT kind, step + 1, dst, 0.85 * sum(came * share)
  FROM walk JOIN shares USING (kind) WHERE src = host AND step < 300 GROUP BY kind, step, dst
), visits AS (
  SELECT kind, host, sum(came) AS came FROM walk GROUP BY kind, host
), ranks AS (
  SELECT kind, host, came * ((SELECT sum(seed) FROM seeds s WHERE s.kind = v.kind) / sum(came) OVER (PARTITION BY kind)) AS rank
  FROM visits v
), hosts AS (
  SELECT host, coalesce(sum(rank) FILTER (kind = 'allow'), 0) AS trust,
         coalesce(sum(rank) FILTER (kind = 'block'), 0) AS distrust
  FROM ranks GROUP BY host
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN distrust / nullif(trust + distrust, 0) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN 'links' ELSE 'rule' END AS method
FROM addresses LEFT JOIN best USING (host, path) LEFT JOIN hosts USING (host)
"""

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

# Exact set similarity and reachability; no sketches.
NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id,
         CASE WHEN len(w) = 0 THEN []
              WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)])
         END AS s
  FROM words
), members AS (
  SELECT doc_id, unnest(s) AS shingle FROM sets
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM members x JOIN members y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM common
  JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, len(any_value(s)) AS n_shingles, min(b) AS component_id, min(b) = doc_id AS kept
FROM sets JOIN reach ON a = doc_id
GROUP BY doc_id
"""

# Trees are numbered from 1 in the order of the languages; tree 0 has their roots as leaves.
# The checksum is computed bit by bit, as there is no function for it.
MERKLE = r"""
WITH RECURSIVE fields AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
         || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
         || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
           lambda crc, byte: list_reduce(
             list_prepend(xor(crc, byte), [0::BIGINT FOR bit IN range(8)]),
             lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || CASE WHEN crc % 3 = 0
           THEN coalesce(octet_length(encode(lowered)) || ':' || lowered, '-')
           ELSE coalesce(octet_length(encode(text)) || ':' || text, '-') END) AS changed,
         dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS n
  FROM fields
), lower_nodes AS (
  SELECT tree, 0 AS level, place, n, leaf AS node FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY place))
  FROM lower_nodes WHERE n > 1 GROUP BY tree, level, place // 8
), subroots AS (
  SELECT tree, node AS subroot FROM lower_nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, tree - 1 AS place, count(*) OVER () AS n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY place))
  FROM upper_nodes WHERE n > 1 GROUP BY level, place // 8
), nodes AS (
  SELECT tree, level, place, n, node FROM lower_nodes WHERE n > 1
  UNION ALL
  SELECT 0, level, place, n, node FROM upper_nodes WHERE n > 1
), places AS (
  SELECT doc_id, tree, 0 AS level, place, n FROM leaves WHERE n > 1
  UNION ALL
  SELECT doc_id, tree, level + 1, place // 8, (n + 7) // 8 FROM places WHERE n > 8
), all_places AS (
  SELECT doc_id, tree, level, place FROM places
  UNION ALL
  SELECT doc_id, 0, u.level, l.tree // (8 ** u.level)::BIGINT
  FROM (SELECT doc_id, tree - 1 AS tree FROM leaves) l
  JOIN (SELECT DISTINCT level FROM upper_nodes WHERE n > 1) u ON true
), steps AS (
  SELECT p.doc_id,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY p.tree = 0, p.level) AS step,
         coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < p.place), '') AS l,
         coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > p.place), '') AS r
  FROM all_places p JOIN nodes s
    ON s.tree = p.tree AND s.level = p.level AND s.place // 8 = p.place // 8
  GROUP BY p.doc_id, p.tree, p.level, p.place
), folds AS (
  SELECT doc_id, 0 AS step, changed AS node FROM leaves
  UNION ALL
  SELECT f.doc_id, s.step, sha256(s.l || f.node || s.r)
  FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step + 1
), folded AS (
  SELECT doc_id, arg_max(node, step) AS folded_root FROM folds GROUP BY doc_id
), proofs AS (
  SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY doc_id
)
SELECT doc_id, leaf, subroot, t.root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
       folded_root, folded_root = t.root AS verified
FROM leaves JOIN subroots USING (tree) JOIN folded USING (doc_id) LEFT JOIN proofs USING (doc_id)
JOIN (SELECT node AS root FROM upper_nodes WHERE n = 1) t ON true
"""

# All pairs; the operator's hashing finds them with the recall that its docstring names.
NEAR_EMBEDDINGS = r"""
WITH RECURSIVE vectors AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM vectors
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b
  FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM vectors
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(b) AS component_id, min(b) = vec_id AS kept
FROM vectors JOIN reach ON reach.a = vec_id LEFT JOIN counts ON counts.a = vec_id
GROUP BY vec_id
"""
