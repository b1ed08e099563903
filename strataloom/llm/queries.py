"""The thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, hard_negatives, line_dedup, merkle, packing, quality_knn, quality_rules, sharding, simhash, suffix_dedup, toxicity, url_filter
from .common import lower_az

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url ends in its document's id; that document's labels are the page's."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    of = F.regexp_extract("url", r"/([0-9]{1,18})(\.html|/)?([?#].*)?$", 1)
    known = pages.where(of != "").select("page_id", of.cast("long").alias("doc_id")).join(_table(spark, sf_dir, "labels"), "doc_id").select("page_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return url_filter.judge(pages, URL_RULES, known)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    events = chat_format.turn_events(rows.unionByName(planted))
    return chat_format.read_back(chat_format.render(chat_format.fold(events)))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(regexp_replace(role, '(### |</turn>|\\|: )', '\\\1', 'g')) + length(regexp_replace(text, '(### |</turn>|\\|: )', '\\\1', 'g')) + 14 AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (lower(role) = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (lower(role) = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(f.first < k.doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def _scored(scores: DataFrame, parts: int, part: int, at: float) -> DataFrame:
    return scores.select("doc_id", quality_knn.held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", F.when(F.col("score") >= at, 1).otherwise(0).alias("predicted"))


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.fit(docs, _table(spark, sf_dir, "labels"), "quality", 3, 1)
    return _scored(quality_knn.score(docs, model), 3, 1, 0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.learn(docs, _table(spark, sf_dir, "labels"), "toxic", 4, 2)
    return _scored(toxicity.score(docs, machine), 4, 2, 0.3)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Exact containment of the items' shingles; texts in bytes differ from texts in characters in no word or shingle.
OP8_SQL = r"""
WITH w AS (SELECT item_id, row_number() OVER () AS n, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
k AS (SELECT *, least(5, len(ws)) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT n, item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS shingle FROM k),
t AS (SELECT n, count(*) AS item_shingles FROM s GROUP BY 1),
d AS (SELECT doc_id, row_number() OVER () AS m, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT m, doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS shingle FROM d, (SELECT DISTINCT k FROM k)),
f AS (SELECT g.m, any_value(g.doc_id) AS doc_id, s.n, any_value(s.item_id) AS item_id, count(*) AS found_shingles FROM g JOIN s USING (k, shingle) GROUP BY g.m, s.n)
SELECT doc_id, item_id, item_shingles, found_shingles, found_shingles / item_shingles AS containment FROM f JOIN t USING (n) WHERE found_shingles >= ceil(0.8 * item_shingles - 1e-9)
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    altered = merkle.leaf("doc_id", "source", "lang", "n_chars", lower_az(F.col("text")))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = merkle.manifest(docs, own={"altered": F.when(tampered, altered)})
    folded = rows.withColumn("folded", merkle.fold(F.coalesce("altered", "leaf"), F.col("path")))
    hexed = [merkle.text_of(F.col(a)).alias(b) for a, b in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    return folded.select(F.col("order").alias("doc_id"), *hexed, merkle.proof(F.col("path")).alias("proof_sha256"), merkle.text_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP11_SQL = rf"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_LEAF} || {_field("text")}) AS leaf,
    sha256({_LEAF} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS altered,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda r, c: list_reduce(list_prepend(xor(r, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, _b: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS crc
  FROM documents
), d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, coalesce(xor(crc, 4294967295) % 3 = 0, false) AS tampered FROM leaves),
up AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY k) AS ds FROM d GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(ds), 8), lambda i: sha256(array_to_string(ds[i + 1 : i + 8], ''))) FROM up WHERE len(ds) > 1
), subroots AS (SELECT lang, ds[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM up WHERE len(ds) = 1),
crown AS (
  SELECT 0 AS level, list(subroot ORDER BY g) AS ds FROM subroots HAVING count(*) > 0
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(ds), 8), lambda i: sha256(array_to_string(ds[i + 1 : i + 8], ''))) FROM crown WHERE len(ds) > 1
), places AS (
  SELECT d.doc_id, d.leaf, d.k, d.lang, s.subroot, row_number() OVER () AS id, CASE WHEN tampered THEN altered ELSE leaf END AS start, s.g FROM d JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang
), steps AS (
  SELECT p.id, u.level AS level, (p.k // pow(8, u.level)::BIGINT) AS i, u.ds FROM places p JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND len(u.ds) > 1
  UNION ALL
  SELECT p.id, 1000 + c.level, (p.g // pow(8, c.level)::BIGINT), c.ds FROM places p JOIN crown c ON len(c.ds) > 1
), parts AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY level) AS step, array_to_string(ds[i // 8 * 8 + 1 : i], '') AS before, array_to_string(ds[i + 2 : i // 8 * 8 + 8], '') AS behind FROM steps
), folded AS (
  SELECT id, 0::BIGINT AS step, start AS acc FROM places
  UNION ALL
  SELECT f.id, f.step + 1, sha256(p.before || f.acc || p.behind) FROM folded f JOIN parts p ON p.id = f.id AND p.step = f.step + 1
), ends AS (SELECT id, arg_max(acc, step) AS folded_root FROM folded GROUP BY id),
proofs AS (SELECT id, sha256(string_agg(before || behind, '' ORDER BY step)) AS proof_sha256 FROM parts GROUP BY id)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM places JOIN ends USING (id) LEFT JOIN proofs USING (id), (SELECT ds[1] AS root FROM crown WHERE len(ds) = 1)
"""


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the law ``bytes``; the place in the shard is the contract's slot, the virtual slot and its map's version come behind."""
    rows, _ = sharding.shard(_table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"), F.col("version").alias("map_version"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op5_line_dedup": OP5_SQL, "op8_decontamination": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op13_hard_negatives": OP13_SQL}
