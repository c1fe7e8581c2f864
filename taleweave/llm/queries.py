"""One query per operator, each over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.llm import alignment, codes, fingerprints, licences, lm, mixing, near_dup, piece_fst, quality, sharding, token_counts, token_files, topk
from taleweave.scratch import fresh_path

END_ID, WORD_VOCABULARY, LIMIT = 2, 49_408, 512
SHARDS = [f"shard-{k:02d}" for k in range(64)]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.pack_documents(_documents(spark, sf_dir), path, WORD_VOCABULARY, END_ID)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = topk.top_k(vectors, vectors.where("id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_documents(spark, sf_dir))
    return judged.select("doc_id", *quality.STATISTICS, "base_failed", "kept")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_fst.encode_documents(_documents(spark, sf_dir), path, keep_ids=False)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir), width=3, percent=85)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written by shard, and where each is read back from."""
    placed = sharding.write_shards(_documents(spark, sf_dir), fresh_path(spark, "shards"), SHARDS)
    return placed.select("doc_id", "slot", "shard", "shard_name")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.count_tokens(_documents(spark, sf_dir), path, (LIMIT,))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), F.col("fits")[0].alias("chars_within"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/language/hundred; every tenth one stands for a licence file."""
    name = F.concat(F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE-")).otherwise(F.lit("text-")), F.col("doc_id").cast("string"))
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), hundred, name)
    return licences.scan(_documents(spark, sf_dir).withColumn("path", path), keep=("doc_id",)).drop("cosine")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = fingerprints.with_neighbours(_documents(spark, sf_dir))
    text = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return met.select("doc_id", "n_chars", "edited_sha256", *text, "near_edited", "near_next")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.correspondences(_documents(spark, sf_dir), a, b)


QUERIES = {
    "op1_mix": op1_mix,
    "op2_token_files": op2_token_files,
    "op3_topk": op3_topk,
    "op4_quality": op4_quality,
    "op5_language_model": op5_language_model,
    "op6_pieces": op6_pieces,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_shards": op8_shards,
    "op10_licences": op10_licences,
    "op9_token_counts": op9_token_counts,
    "op11_fingerprints": op11_fingerprints,
    "op12_codes": op12_codes,
    "op13_alignment": op13_alignment,
}

_WORD = r"[^\x20\x09-\x0D]+"

_MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM per
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), chosen AS (
  SELECT *, (SELECT arg_min(level, cap / weight) FROM levels WHERE level * weight <= cap) AS common FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN common IS NULL OR common * weight > cap THEN cap ELSE common * weight END AS target,
         ('0x' || substr(md5('7:' || coalesce('s' || source, '')), 1, 4))::INTEGER / 65536.0::DOUBLE AS first
  FROM chosen
), placed AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY
    lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 5),
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2), size, doc_id) AS place
  FROM sized
), rated AS (
  SELECT p.*, t.source_size, t.target, t.first, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(floor(place * rate + first) - floor((place - 1) * rate + first) AS BIGINT) * size AS taken
FROM rated
"""

_TOPK = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

_NEAR = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_transform(regexp_extract_all(text, '{_WORD}'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words
), shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
texts AS (SELECT list_sort(s) AS k, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1),
members AS (SELECT s.doc_id, t.rep FROM sets s JOIN texts t ON list_sort(s.s) = t.k),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT rep FROM texts) AND b.doc_id IN (SELECT rep FROM texts)
  GROUP BY 1, 2
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (
  SELECT rep, rep FROM texts UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other
), least AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT s.doc_id, CAST(z.n AS BIGINT) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id,
       coalesce(l.component, s.doc_id) = s.doc_id AS kept
FROM sets s JOIN sizes z USING (doc_id) LEFT JOIN members m USING (doc_id) LEFT JOIN least l ON l.id = m.rep
"""


def _shards_sql() -> str:
    slots = sharding.SLOTS
    return f"""
    WITH filled AS (SELECT {sharding.fill_table(SHARDS)} AS owner, {SHARDS} AS names),
    hashed AS (SELECT doc_id, CASE WHEN doc_id IS NULL THEN 0 ELSE
      CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT % {slots} AS INTEGER) END AS slot FROM documents)
    SELECT doc_id, slot, CAST(owner[slot + 1] AS INTEGER) AS shard, names[owner[slot + 1] + 1] AS shard_name FROM hashed, filled
    """


def _codes_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS, scale: int = codes.SCALE) -> str:
    """Lloyd rounds without deltas: every round adds up all vectors anew."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (
  SELECT rid, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far
  FROM (SELECT r.rid, r.part, b.entry, list_sum(list_transform(r.x, lambda v, i: (v - b.x[i]) * (v - b.x[i]))) AS far
        FROM cut r JOIN books{k} b USING (part))
  GROUP BY rid, part
)""")
        if k < rounds:
            steps.append(f"""
sums{k} AS (
  SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n
  FROM cut JOIN near{k} USING (rid, part), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM cut))) AS i) GROUP BY part, entry, i
), moved{k} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM sums{k} GROUP BY part, entry
), books{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM books{k} b LEFT JOIN moved{k} m ON b.part = m.part AND b.entry = m.entry
)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT rid, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS part)
), books0 AS (SELECT part, rid - 1 AS entry, x FROM cut WHERE rid <= {entries}),
{",".join(steps)}
, coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM near{rounds} GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM books{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""


SQL = {"op1_mix": _MIX, "op3_topk": _TOPK, "op7_near_duplicates": _NEAR, "op8_shards": _shards_sql(), "op12_codes": _codes_sql()}
