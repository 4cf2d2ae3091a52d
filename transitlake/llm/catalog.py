"""Registered jobs of the training-data operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm import (bpe, centroids, decontaminate, infill, langid, minhash, mixing, planes, quality_model,
                             quality_rules, suffixes, vectors, warc)
from transitlake.llm.common import crc_mod, prepare, scratch, table

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def job(key: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        run.__name__, run.__doc__ = key, fn.__doc__
        JOBS[key] = run
        if sql is not None:
            ORACLE_SQL[key] = sql
        return fn
    return deco


_MIX_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')), 1, 12) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM d GROUP BY source),
w AS (SELECT *, (rk - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
total AS (SELECT sum(source_size)::BIGINT AS words FROM w),
-- rounds of sharing: those above their cap stop there, the rest shares what is left
rounds AS (
  SELECT 0 AS n, words / (SELECT sum(weight) FROM w)::DOUBLE AS share FROM total
  UNION ALL
  SELECT n + 1, (SELECT (any_value(t.words) - coalesce(sum(cap) FILTER (cap < r.share * weight), 0))::DOUBLE
                   / sum(weight) FILTER (NOT cap < r.share * weight) FROM w, total t)
  FROM rounds r WHERE n < (SELECT count(*) FROM w)),
t AS (SELECT w.*, CASE WHEN cap < share * weight THEN cap::DOUBLE ELSE share * weight END AS target
      FROM w, (SELECT max(share) AS share FROM rounds)),
p AS (SELECT d.*, t.rk, t.source_size, t.target, e.epoch,
             sum(d.size) OVER (PARTITION BY t.rk, e.epoch ORDER BY d.k, d.doc_id, d.size
                               ROWS UNBOUNDED PRECEDING) AS done
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1, 2]) AS epoch) e),
f AS (SELECT *, (source_size * epoch + done)::DOUBLE / target AS finish FROM p WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, rk, epoch, k, doc_id, done ROWS UNBOUNDED PRECEDING) AS up_to
      FROM f),
got AS (SELECT doc_id, k, done, rk, sum(CASE WHEN up_to <= words THEN size ELSE 0 END) AS taken
        FROM o, total GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(got.taken, 0)::BIGINT AS taken
FROM p LEFT JOIN got ON p.doc_id IS NOT DISTINCT FROM got.doc_id AND p.done = got.done AND p.rk = got.rk AND p.size > 0
WHERE p.epoch = 0
"""


@job("op9_source_mix", _MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; words taken of each document."""
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target",
                    (F.col("size") * F.col("times")).cast("long").alias("taken"))


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@job("op2_token_planes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, written as byte-plane files in id order, and read back."""
    path = scratch(spark, "token-planes")
    planes.write(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"))
    return planes.digest(planes.read(spark, path))


@job("op8_forced_boundary_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded and decoded by forced-boundary splitting."""
    return bpe.encode(table(spark, sf_dir, "documents"), "word_bpe_49k.json", ids=False,
                      decoded=False)


@job("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from four fifths of the labelled rows."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    model = langid.learn(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, keep=["held_out"])


@job("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of risk-controlled cutoffs per language."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@job("op5_minhash_groups")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups on four-word shingles at similarity 0.8."""
    return minhash.groups(table(spark, sf_dir, "documents"), size=4)


@job("op10_sparse_suffixes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 words or more that stand in several documents."""
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def quality_weights(spark: SparkSession, sf_dir: str):
    """The classifier of ``labels.quality``, without the rows that are held out."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1)
    return quality_model.fit(table(spark, sf_dir, "documents"), labels)


@job("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, learned from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    out = quality_model.score(docs, quality_weights(spark, sf_dir), keep=["held_out"])
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@job("op7_subspace_vectors")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with cosine 0.93 or more, as links and components."""
    return vectors.groups(table(spark, sf_dir, "embeddings"), cosine=0.93)


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html
"""


@job("op3_warc_pages", _WARC_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    warc.register(spark)
    path = scratch(spark, "warc")
    records = warc.page_records(table(spark, sf_dir, "pages"), f"{path}-keepers")
    records.write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path).filter(F.col("warc_type").isin("response", "revisit"))
    return warc.page_digest(read)


_LEAK_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS k,
         array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT k FROM bw), unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
found AS (SELECT DISTINCT rid, i, k, item FROM dw JOIN bw USING (k, gram)),
hit AS (SELECT rid, count(DISTINCT j) AS n FROM found, unnest(range(i, i + k)) AS t(j) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT rid, item FROM found WHERE item IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit,
       coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.names, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.rid = hit.rid LEFT JOIN items ON d.rid = items.rid
"""


@job("op11_fm_index_leaks", _LEAK_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that stand in a benchmark passage, and its items."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def _assign_sql(n: int) -> str:
    """Distances to the centroids of round n, the nearest, and the centroids of the next round."""
    return f"""
d{n} AS (SELECT rid, c, sum((q - m) * (q - m)) AS dist FROM x JOIN c{n} USING (d) GROUP BY rid, c),
a{n} AS (SELECT rid, dist, c FROM d{n} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1),
c{n + 1} AS (
  SELECT c{n}.c, c{n}.d, coalesce(s.m, c{n}.m) AS m
  FROM c{n} LEFT JOIN (SELECT c, d, (sum(q) - ((sum(q) % count(*)) + count(*)) % count(*)) // count(*) AS m
                       FROM x JOIN a{n} USING (rid) GROUP BY c, d) s ON c{n}.c = s.c AND c{n}.d = s.d)"""


_CENTROID_SQL = f"""
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
x AS (
  SELECT rid, i AS d, floor(64 * CAST(embedding[i] AS DOUBLE))::BIGINT AS q
  FROM e, unnest(range(1, 65)) AS t(i)),
first AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), embedding) - 1 AS c
  FROM e QUALIFY c < 16),
c0 AS (SELECT c, d, q AS m FROM first JOIN x USING (rid)),{",".join(_assign_sql(n) for n in range(4))},
s AS (SELECT c, sum(dist) AS cluster_inertia FROM a3 GROUP BY c),
h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, a3.c::INT AS cluster, dist::BIGINT AS distance, cluster_inertia::BIGINT AS cluster_inertia,
       (SELECT sum(dist) FROM a3)::BIGINT AS inertia, centroid_sha256
FROM e JOIN a3 USING (rid) JOIN s ON a3.c = s.c JOIN h ON a3.c = h.c
"""


@job("op12_scalar_tables", _CENTROID_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in sixteen clusters after three rounds, with exact distances and inertias."""
    found, centres = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(found, centres)


_INFILL_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
k AS (
  SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS k1, ('0x' || s[9:16])::BIGINT % (n + 1) AS k2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR ('0x' || s[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || s[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, substr(t, 1, least(k1, k2)) AS pre, substr(t, least(k1, k2) + 1, abs(k1 - k2)) AS mid,
         substr(t, greatest(k1, k2) + 1) AS suf FROM k)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN least(k1, k2) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN abs(k1 - k2) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@job("op13_rank_index_infill", _INFILL_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut into prefix, middle and suffix, reordered and rebuilt."""
    made = infill.restore(infill.transform(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))
