"""Queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import canonical, cutoff, history, mojibake, packing, runs, tokenizer, topn
from strandline.session import distinct_rows, materialize, table

CONTAINER_TOKENS = 2048
# Words for "licence" in the languages of the values, and another name of a reference word.
LICENCE_FILLERS = ("license", "licence", "licencia", "lizenz", "lic", "giay phep", "version", "v")
LICENCE_ALIASES = {"noderivs": "noderivatives", "zero": "0"}


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frame_candidates").filter(F.col("video_path").isNotNull())


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return distinct_rows(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.keep_fraction(_frames(spark, d), "video_path", "frame_id", "sharpness", 1, 4)[1].select("frame_id")


def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    scored = cutoff.scored_rows(_frames(spark, d), "video_path", "frame_id", "sharpness")
    return cutoff.find_cutoffs(scored, 1, 4).toDF("video_path", "n_scored", "cutoff", "n_kept")


def _licences(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_to_entries(
        table(spark, d, "image_results"),
        "result_id",
        "license",
        table(spark, d, "license_names"),
        "license_id",
        ("name", "long_name", "name_vi"),
        "family",
        "version",
        LICENCE_FILLERS,
        LICENCE_ALIASES,
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _licences(spark, d).select("result_id", "license_id")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    found = _licences(spark, d).filter("license_id = 0")
    return found.groupBy("license").agg(F.count(F.lit(1)).alias("n_results"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(_frames(spark, d), "item_id", "ts", "frame_id", "hash_value")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).filter("n_events > 1").select(F.col("first_id").alias("first_frame_id"), F.col("last_id").alias("last_frame_id"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("item_id", F.col("first_id").alias("first_frame_id"), F.col("last_id").alias("last_frame_id"), "n_events", "start", "end", F.round("duration", 6).alias("duration"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.check_batches(_frames(spark, d), "frame_id", "batch_id", "hash_value").select("frame_id").distinct()


def p5_places(spark: SparkSession, d: str) -> DataFrame:
    return history.check_batches(_frames(spark, d), "frame_id", "batch_id", "hash_value", ("video_path", "ts")).select("frame_id", "video_path", "ts")


def _top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_frames(spark, d), "video_path", "sharpness", "ts", "frame_id", 5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("frame_id")


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("video_path", "place", "frame_id", "sharpness", "ts")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(_documents(spark, d), "doc_id", "text", "ids")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialize(tokenizer.count_tokens(_documents(spark, d), "doc_id", "text"), "sizes")
    return packing.pack(sizes, "doc_id", "n_tokens", CONTAINER_TOKENS)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_wrong_decoding(_documents(spark, d), "doc_id", "text", only_found=True).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_wrong_decoding(_documents(spark, d), "doc_id", "text", only_found=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_cutoffs, p3_found, p3_unmatched, p4_found, p4_runs, p5_found, p5_places, p6_found, p6_ranked, p7_ids, p8_packed, p9_found, p9_restored)}


_SCORED = """scored AS (
  SELECT DISTINCT frame_id, video_path, sharpness, ts FROM frame_candidates
  WHERE video_path IS NOT NULL AND sharpness IS NOT NULL AND NOT isnan(sharpness))"""

_CUTOFFS = f"""{_SCORED}, placed AS (
  SELECT video_path, sharpness, row_number() OVER (PARTITION BY video_path ORDER BY sharpness DESC) AS place,
         count(*) OVER (PARTITION BY video_path) AS n FROM scored),
cutoffs AS (SELECT video_path, n, sharpness AS cutoff FROM placed WHERE place = (n + 3) // 4)"""

_RUNS = """events AS (
  SELECT DISTINCT item_id, ts, frame_id, hash_value FROM frame_candidates
  WHERE video_path IS NOT NULL AND item_id IS NOT NULL AND hash_value IS NOT NULL AND hash_value <> 0),
marked AS (
  SELECT *, coalesce(CAST(bit_count(xor(hash_value, lag(hash_value) OVER w)) > 6 AS INT), 1) AS is_start
  FROM events WINDOW w AS (PARTITION BY item_id ORDER BY ts, frame_id)),
numbered AS (
  SELECT *, sum(is_start) OVER (PARTITION BY item_id ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (
  SELECT item_id, arg_min(frame_id, (ts, frame_id)) AS first_frame_id, arg_max(frame_id, (ts, frame_id)) AS last_frame_id,
         CAST(count(*) AS BIGINT) AS n_events, min(ts) AS "start", max(ts) AS "end", round(max(ts) - min(ts), 6) AS duration
  FROM numbered GROUP BY item_id, run)"""

# Batches in order; the state holds the hashes accepted so far.
_HISTORY = """u AS MATERIALIZED (
  SELECT DISTINCT frame_id, batch_id, hash_value AS h FROM frame_candidates
  WHERE video_path IS NOT NULL AND hash_value IS NOT NULL AND hash_value <> 0 AND batch_id IS NOT NULL),
b AS MATERIALIZED (SELECT row_number() OVER (ORDER BY batch_id) AS n, batch_id, list(DISTINCT h) AS hs FROM u GROUP BY batch_id),
go AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS accepted, CAST([] AS BIGINT[]) AS rejected
  UNION ALL
  SELECT n, list_concat(accepted, list_filter(hs, lambda h: NOT list_contains(bad, h))), bad
  FROM (SELECT b.n, b.hs, go.accepted, list_filter(b.hs, lambda h: len(list_filter(go.accepted, lambda a: bit_count(xor(a, h)) <= 6)) > 0) AS bad
    FROM go JOIN b ON b.n = go.n + 1)),
cases AS (SELECT DISTINCT u.frame_id FROM u JOIN b USING (batch_id) JOIN (SELECT n, unnest(rejected) AS h FROM go) r ON r.n = b.n AND r.h = u.h)"""

_TOP = f"""{_SCORED}, ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY video_path ORDER BY sharpness DESC, ts, frame_id) AS INT) AS place FROM scored)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_CUTOFFS} SELECT frame_id FROM scored JOIN cutoffs USING (video_path) WHERE sharpness >= cutoff",
        "p2_cutoffs": f"""WITH {_CUTOFFS} SELECT video_path, CAST(n AS BIGINT) AS n_scored, cutoff,
            (SELECT count(*) FROM scored s WHERE s.video_path = c.video_path AND s.sharpness >= c.cutoff) AS n_kept FROM cutoffs c""",
        "p4_found": f"WITH {_RUNS} SELECT first_frame_id, last_frame_id FROM runs WHERE n_events > 1",
        "p4_runs": f"WITH {_RUNS} SELECT * FROM runs",
        "p5_found": f"WITH RECURSIVE {_HISTORY} SELECT frame_id FROM cases",
        "p5_places": f"""WITH RECURSIVE {_HISTORY} SELECT DISTINCT frame_id, video_path, ts FROM cases JOIN frame_candidates USING (frame_id)""",
        "p6_found": f"WITH {_TOP} SELECT frame_id FROM ranked WHERE place <= 5",
        "p6_ranked": f"WITH {_TOP} SELECT video_path, place, frame_id, sharpness, ts FROM ranked WHERE place <= 5",
    }
