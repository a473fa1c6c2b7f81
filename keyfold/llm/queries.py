"""Registered queries of this folder and their SQL twins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import (alignment, exact, html_text, minhash, mixing, packing, periods, phrases, pii, redirects, tokens,
                         topk, toxicity)
from keyfold.session import new_stage_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = """
WITH e AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op1_voronoi_top_k", OP1_SQL)
def voronoi_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op2_phrase_automata")
def phrase_automata(spark, sf_dir):
    return phrases.remove_recurring(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, html, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages)),
r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT p.page_id, p.host, p.path, h || q AS rule, v,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(h || q) DESC) AS n
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
"""


@query("op3_redirect_verdicts", OP3_SQL)
def redirect_verdicts(spark, sf_dir):
    """The SQL has no components: the given pages hold no canonical links or refreshes, which a test
    with a fixture covers."""
    return redirects.judge_urls(table(spark, sf_dir, "pages"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op4_exact_duplicates", OP4_SQL)
def exact_duplicates(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op5_personal_data")
def personal_data(spark, sf_dir):
    return pii.personal_data_digest(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  md5('mix-1:' || doc_id) AS k FROM documents),
src AS (SELECT s, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY s) - 1) % 3 + 1]::DOUBLE AS w
        FROM d GROUP BY s),
lv AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
              (1.5::DOUBLE * sum(source_size) OVER ()
               - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0 * source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY 2.0 * source_size / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
       FROM src),
lam AS (SELECT max(level) AS l FROM lv),
t AS (SELECT s, source_size, least(l * w, cap) AS target FROM lv, lam),
b AS (SELECT d.*, source_size, target,
             coalesce(sum(size) OVER (PARTITION BY s ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
      FROM d JOIN t USING (s))
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM b
"""


@query("op6_mix_sources", OP6_SQL)
def mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op7_tensored_minhash")
def tensored_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.OrdinalModel:
    """Fitted on the labelled ones among ``docs``."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.fit(docs, labels.select("doc_id", toxicity.severity_grade(
        F.col("toxic"), F.col("quality")).alias("grade")))


@query("op8_ordinal_toxicity")
def ordinal_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity_model(spark, docs, sf_dir))


@query("op9_token_files")
def token_files(spark, sf_dir):
    path = new_stage_path(spark, "tokens")
    tokens.write_token_files(table(spark, sf_dir, "documents"), path, BYTE_TOKENIZER)
    return tokens.token_digest(tokens.read_token_files(spark, path))


# The query runs by itself, so that its encoders may remember more than beside the pipeline's other stages.
PACK_CACHE_ENTRIES = 800_000


@query("op10_pack_sequences")
def pack_sequences(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER, entries=PACK_CACHE_ENTRIES)


@query("op11_tokenizer_alignment")
def tokenizer_alignment(spark, sf_dir):
    return alignment.alignment_digest(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_MODEL)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The documents, places and periods that the registered query makes periodic."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


@query("op12_periodic_runs")
def periodic_runs(spark, sf_dir):
    found = periods.collapse_runs(table(spark, sf_dir, "documents"), rewrite=repeat_tail)
    # Structs compare field by field: the greatest length, then the smallest start and period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("l"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    told = found.withColumn("_top", longest)
    length, period = F.col("_top.l"), -F.col("_top.p")
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.s")).alias("start"), length.alias("length"),
        period.alias("period"), F.expr("1000 * _top.l div -_top.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_html_text")
def page_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
