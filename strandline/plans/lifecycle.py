"""Queries on states, resuming, progress and limits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import vectors
from strandline.operators import lifecycle, ranged, relational, streams
from strandline.plans.queries import _CONSECUTIVE, _META, _decided, meta, query
from strandline.session import table

_PAIRS = ", ".join(f"('{a}', '{b}')" for a, bs in lifecycle.TRANSITIONS.items() for b in bs)
_LOG = f"""allowed(a, b) AS (VALUES {_PAIRS}),
log AS (SELECT DISTINCT item_id, observed_at, attempts, status, fraction, error FROM item_states WHERE item_id IS NOT NULL AND status IS NOT NULL AND observed_at IS NOT NULL),
steps AS (SELECT *, lag(status) OVER (PARTITION BY item_id ORDER BY observed_at, attempts, status, fraction, error) AS before FROM log),
judged AS (SELECT *, (before IS NULL OR before = status OR EXISTS (SELECT 1 FROM allowed WHERE a = before AND b = status)) AS legal FROM steps)"""


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "item_states").select("item_id", "observed_at", "attempts", "status", "fraction", "error").filter(F.col("observed_at").isNotNull()).distinct()
    order = [F.asc("observed_at"), F.asc_nulls_last("attempts"), F.asc("status"), F.asc_nulls_last("fraction"), F.asc_nulls_last("error")]
    return lifecycle.replay(log, "item_id", order, "status", "observed_at", "fraction", "error")


@query(
    f"""WITH {_LOG} SELECT item_id, observed_at, before, status AS after, legal,
    CASE WHEN status = 'completed' THEN 1.0 WHEN fraction IS NULL THEN 0.0 ELSE least(greatest(fraction, 0.0), 1.0) END AS progress,
    CASE WHEN status <> 'completed' THEN left(error, 4000) END AS error, CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN observed_at END AS ended FROM judged"""
)
def queue_transitions(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d)


@query(f"WITH {_LOG} SELECT before, status AS after, count(*) AS n, count(DISTINCT item_id) AS items FROM judged WHERE NOT legal GROUP BY ALL")
def illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d).filter("NOT legal").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"))


_WORK = """w AS (SELECT DISTINCT j.run_signature, q.job_id, q.video_path, q.status FROM queue_items q JOIN (SELECT DISTINCT job_id, run_signature FROM jobs) j USING (job_id)
  WHERE j.run_signature IS NOT NULL AND q.video_path IS NOT NULL),
done AS (SELECT DISTINCT run_signature, video_path FROM w WHERE status = 'completed')"""


@query(
    f"""WITH {_WORK} SELECT DISTINCT w.job_id, w.run_signature, w.video_path, CASE WHEN d.video_path IS NOT NULL THEN 'reuse' ELSE 'process' END AS action
    FROM w LEFT JOIN done d ON d.run_signature = w.run_signature AND d.video_path = w.video_path"""
)
def resume_plan(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("job_id", "run_signature").filter(F.col("run_signature").isNotNull()).distinct()
    items = table(spark, d, "queue_items").select("job_id", "video_path", "status").filter(F.col("video_path").isNotNull()).join(jobs, "job_id")
    key = ["run_signature", "video_path"]
    return lifecycle.resume_plan(items.select("job_id", *key).distinct(), items.filter("status = 'completed'"), key).select("job_id", *key, "action")


# The outputs of the first three batches are there already.
_LABEL = "floor(round(ts * 1000))"


@query(
    f"""WITH RECURSIVE {_CONSECUTIVE}, x AS (SELECT go.video_path, go.frame_id, go.status, f.ts, CASE WHEN go.status = 'saved' THEN CAST({_LABEL} AS BIGINT) END AS label FROM go JOIN f USING (frame_id)),
    there AS (SELECT DISTINCT video_path, CAST({_LABEL} AS BIGINT) AS label FROM frame_candidates WHERE video_path IS NOT NULL AND batch_id <= 3),
    k AS (SELECT x.*, row_number() OVER (PARTITION BY x.video_path, x.label ORDER BY ts, frame_id) AS n, t.label IS NOT NULL AS there
      FROM x LEFT JOIN there t ON t.video_path = x.video_path AND t.label = x.label)
    SELECT video_path, frame_id, CASE WHEN status = 'saved' AND (there OR n > 1) THEN 'existing' ELSE status END AS status FROM k"""
)
def existing_skip(spark: SparkSession, d: str) -> DataFrame:
    label = F.floor(F.round(F.col("ts") * 1000)).cast("long")
    outputs = table(spark, d, "frame_candidates").filter("video_path IS NOT NULL AND batch_id <= 3").select("video_path", label.alias("label"))
    decided = _decided(spark, d, False, {"ts": "ts"})
    return streams.mark_existing(decided, "video_path", "ts", "frame_id", label, outputs).select("video_path", "frame_id", "status")


@query(
    f"""WITH {_META} SELECT video_path, least(5.0, last_ts) AS range_start, least(60.0, last_ts) AS range_end, least(60.0, last_ts) > least(5.0, last_ts) AS usable FROM m"""
)
def time_range(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.time_range(meta(spark, d), F.lit(5.0), F.lit(60.0), F.col("last_ts")).select("video_path", "range_start", "range_end", "usable")


@query(
    r"""WITH s AS (SELECT DISTINCT item_id, observed_at, message, started_at FROM item_states WHERE item_id IS NOT NULL AND observed_at IS NOT NULL),
    x AS (SELECT *, coalesce(TRY_CAST(regexp_extract(message, '(\d+)\s*/\s*(\d+)\s*(?:mốc|frame)', 1) AS INT), 0) AS done,
      CASE WHEN regexp_matches(message, '(\d+)\s*/\s*(\d+)\s*(?:mốc|frame)') THEN greatest(1, TRY_CAST(regexp_extract(message, '(\d+)\s*/\s*(\d+)\s*(?:mốc|frame)', 2) AS INT)) ELSE 0 END AS total,
      greatest(0.0, CASE WHEN started_at <> 0 THEN epoch(observed_at) - started_at ELSE 0.0 END) AS elapsed FROM s),
    y AS (SELECT *, CASE WHEN done > 0 AND elapsed > 0.2 THEN done / elapsed END AS fps FROM x)
    SELECT item_id, observed_at, done, total, round(fps, 6) AS fps, round(CASE WHEN total > done THEN (total - done) / fps END, 6) AS eta FROM y"""
)
def telemetry(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "item_states").select("item_id", "observed_at", "message", "started_at").filter("item_id IS NOT NULL AND observed_at IS NOT NULL").distinct()
    s = s.withColumn("now", F.unix_micros(F.col("observed_at").cast("timestamp")) / 1e6)
    return lifecycle.telemetry(s, "message", "started_at", "now").select("item_id", "observed_at", "done", "total", F.round("fps", 6).alias("fps"), F.round("eta", 6).alias("eta"))


# Most rows of one answer of each service.
LIMITS = {"duckpix": 100, "wikivault": 50, "openpix": 20, "fotarra": 80, "Pikselio": 200, "snaplume": 30}


@query(
    f"""WITH limits(source, most) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in LIMITS.items())}),
    one AS (SELECT query_text, source, url, min(result_id) AS result_id FROM image_results WHERE url IS NOT NULL GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_text, source ORDER BY result_id, url) AS place FROM one)
    SELECT query_text, source, url, result_id, CAST(place AS INT) AS place FROM placed JOIN limits USING (source) WHERE place <= most"""
)
def source_limited(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.top_per_source(table(spark, d, "image_results").select("query_text", "source", "url", "result_id"), "query_text", "source", "url", "result_id", LIMITS)


@query(
    """WITH f AS (SELECT DISTINCT video_path, hash_value, batch_id FROM frame_candidates WHERE video_path IS NOT NULL AND hash_value IS NOT NULL AND hash_value <> 0),
    a AS (SELECT DISTINCT video_path, hash_value FROM f WHERE batch_id >= 2), b AS (SELECT DISTINCT video_path, hash_value FROM f WHERE batch_id <= 10),
    x AS (SELECT coalesce(a.video_path, b.video_path) AS video_path, b.hash_value IS NULL AS lost, a.hash_value IS NULL AS stray
      FROM a FULL JOIN b ON a.video_path = b.video_path AND a.hash_value = b.hash_value)
    SELECT video_path, count(*) FILTER (lost) AS missing, count(*) FILTER (stray) AS stray, bool_or(lost OR stray) AS rebuild FROM x GROUP BY video_path"""
)
def bucket_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Buckets kept up to one batch against the hashes from another on: what must be rebuilt."""
    f = table(spark, d, "frame_candidates").filter("video_path IS NOT NULL AND hash_value IS NOT NULL AND hash_value <> 0").select("video_path", "hash_value", "batch_id")
    buckets = f.filter("batch_id <= 10").select("video_path", "hash_value", F.explode(vectors.bucket_keys(F.col("hash_value"))))
    return lifecycle.bucket_faults(f.filter("batch_id >= 2"), buckets, "video_path", "hash_value")


@query(
    """WITH l AS (SELECT item_id, max(fraction) AS fraction, max(saved) AS saved FROM item_states WHERE item_id IS NOT NULL GROUP BY item_id),
    q AS (SELECT DISTINCT job_id, position, item_id FROM queue_items WHERE job_id IS NOT NULL AND position IS NOT NULL)
    SELECT q.job_id, q.position, q.item_id, coalesce(l.fraction, 0.0) AS fraction, coalesce(l.saved, 0) AS saved FROM q LEFT JOIN l USING (item_id)"""
)
def progress_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Every place of every job with the progress of its item; places without progress stand at 0."""
    q = table(spark, d, "queue_items").select("job_id", "position", "item_id").filter("job_id IS NOT NULL AND position IS NOT NULL").distinct()
    best = table(spark, d, "item_states").filter("item_id IS NOT NULL").groupBy("item_id").agg(F.max("fraction").alias("fraction"), F.max("saved").alias("saved"))
    return q.join(best, "item_id", "left").select("job_id", "position", "item_id", F.coalesce("fraction", F.lit(0.0)).alias("fraction"), F.coalesce("saved", F.lit(0)).alias("saved"))


@query(
    """SELECT left(trim(author, ' '), 80) AS name, arg_max(license, (fetched_at, result_id)) AS license FROM image_results
    WHERE author IS NOT NULL AND trim(author, ' ') <> '' AND license IS NOT NULL AND fetched_at IS NOT NULL GROUP BY 1"""
)
def preset_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Named settings, the last one of a name (80 characters at most) wins."""
    r = table(spark, d, "image_results").select(F.substring(F.trim("author"), 1, 80).alias("name"), "license", "fetched_at", "result_id")
    r = r.filter("name <> '' AND license IS NOT NULL AND fetched_at IS NOT NULL")
    return relational.latest(r, ("name",), ("fetched_at", "result_id")).select("name", "license")


@query(
    r"""WITH n AS (SELECT DISTINCT regexp_extract(video_path, '([^/]+)$', 1) AS name FROM queue_items WHERE video_path IS NOT NULL)
    SELECT CAST(0 AS BIGINT) AS place, 'all' AS name UNION ALL SELECT row_number() OVER (ORDER BY encode(name)) AS place, name FROM n"""
)
def video_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names in order behind the choice of all, numbered over range parts."""
    names = table(spark, d, "queue_items").filter("video_path IS NOT NULL").select(F.regexp_extract("video_path", "([^/]+)$", 1).alias("name")).distinct()
    numbered = ranged.running_sum(names.withColumn("_one", F.lit(1)), "_one", [F.asc("name")], place=F.lit(1).cast("long"))
    return spark.range(1).select(F.col("id").alias("place"), F.lit("all").alias("name")).unionByName(numbered.select("place", "name"))
