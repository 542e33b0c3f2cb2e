"""Registered queries of the numbered operators, with their SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import small_batches
from tickloom.llm.common import table as whole_table
from tickloom.plans.inputs import registrar
from tickloom.plans.lineage import checkpoint_folder

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Product quantisation by plain comparison with every entry, one pair of common tables a round."""
    nearest = """SELECT p.id, p.label, p.part, p.c, min({{'d': list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) AS m
  FROM p JOIN b{0} b USING (part) GROUP BY ALL"""
    steps = [f"""k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT id, label, CAST(i AS INT) AS part, list_slice(v, i * len(v) // {parts} + 1, (i + 1) * len(v) // {parts}) AS c FROM k, range({parts}) r(i)),
b0 AS MATERIALIZED (SELECT part, id - 1 AS e, c FROM p WHERE id <= {entries})"""]
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({nearest.format(i)}),
u{i} AS (SELECT part, m.e AS e, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM a{i}),
s{i} AS (SELECT part, e, pos, sum(x) AS s, count(*) AS n FROM u{i} GROUP BY ALL),
f{i} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM s{i} GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(f.c, b.c) AS c FROM b{i} b LEFT JOIN f{i} f USING (part, e))""")
    return f"""WITH {', '.join(steps)},
a AS MATERIALIZED ({nearest.format(rounds)}),
coded AS (SELECT id, label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a GROUP BY ALL)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY coded.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN k USING (id)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return whole_table(spark, sf_dir, name)


@query(
    "op3_warc_revisits",
    """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to FROM p LEFT JOIN m USING (payload_digest)""",
)
def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import warc

    path = f"{checkpoint_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.records(table(spark, sf_dir, "pages")), path)
    back = warc.read_archives(spark, path)
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import pii

    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, model=pii.fit(docs)).drop("found")


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import secrets

    return secrets.judge(table(spark, sf_dir, "documents"))


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents"), k=4, threshold="0.85")


@query("op8_benchmark_decontamination")
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import decontaminate

    return decontaminate.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_quality_bayes")
def op2_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import quality

    out = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "source", "lang", "p_doc", "p_site", "p_good", "keep")


@query("op6_language_compression")
def op6_language_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    out = language.classify(docs, language.learn(docs.where(~held_out)))
    return out.withColumn("held_out", held_out)


@query("op4_piece_ids")
def op4_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import pieces

    vocabulary = pieces.Vocabulary.load()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.withColumn("p", pieces.encoded(spark, F.col("text"), vocabulary))
    return out.select("doc_id", "p.ids", F.size("p.ids").cast("long").alias("n_ids"), "p.exact")


@query("op9_main_text")
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import extract

    pages = table(spark, sf_dir, "pages")
    return extract.extract(pages, extract.fit(pages))


@query("op1_prefix_forest")
def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import forest

    return forest.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op11_url_filter")
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import url_filter, url_labels

    labelled = spark.createDataFrame(url_labels.labelled(), "url string, label int")
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.fit(labelled))


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import codes

    return codes.compress(table(spark, sf_dir, "embeddings"))


@query(
    "op13_source_divergence",
    r"""WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
t AS MATERIALIZED (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS whole FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM kept GROUP BY ALL),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, (SELECT coalesce(sum(n), 0) FROM n WHERE n.lang = d.lang AND n.source = d.source) AS total FROM d GROUP BY ALL),
c AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + CAST(1000000000::HUGEINT * (coalesce(n, 0) + 5) // (g.total + 5 * v) AS BIGINT) AS p,
         1 + CAST(1000000000::HUGEINT * (whole + 5) // (v.total + 5 * v) AS BIGINT) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM c WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50""",
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))
