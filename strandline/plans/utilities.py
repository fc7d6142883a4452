"""More queries of the core: previews, names, identifiers, reports in JSON and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import ranged, relational, streams
from strandline.plans.queries import _CUT_SQL, _FRAMES, _LATEST, _META, _NODES, CUTS, QUALITY, _report_tables, frames, latest_states, meta, query
from strandline.session import table


@query(
    f"""WITH RECURSIVE {_FRAMES}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_path ORDER BY ts, frame_id) AS n FROM f),
    go AS (SELECT video_path, n, frame_id, ts, true AS kept, ts + 1.0 AS due FROM o WHERE n = 1
      UNION ALL SELECT o.video_path, o.n, o.frame_id, o.ts, o.ts + 1e-6 >= go.due, CASE WHEN o.ts + 1e-6 >= go.due THEN o.ts + 1.0 ELSE go.due END
      FROM go JOIN o ON o.video_path = go.video_path AND o.n = go.n + 1),
    d AS (SELECT go.video_path, go.frame_id, go.ts, abs(f.brightness - lag(f.brightness) OVER (PARTITION BY go.video_path ORDER BY go.ts, go.frame_id)) AS change FROM go JOIN f USING (frame_id) WHERE kept),
    k AS (SELECT *, row_number() OVER (PARTITION BY video_path ORDER BY ts, frame_id) AS place FROM d WHERE change >= 0.05)
    SELECT video_path, frame_id, CAST(place AS INT) AS place, round(change, 6) AS change FROM k WHERE place <= 32"""
)
def preview_scan(spark: SparkSession, d: str) -> DataFrame:
    """A sample a second, its change against the sample before, and the first 32 great changes of each video."""
    f = frames(spark, d)
    kept = streams.rate_limited(f, "video_path", "ts", "frame_id", 1.0).join(f.select("frame_id", "brightness"), "frame_id")
    order = [F.asc("ts"), F.asc("frame_id")]
    w = Window.partitionBy("video_path").orderBy(*order)
    near = ranged.previous(kept, "video_path", order, before=F.col("brightness"))
    changed = near.withColumn("change", F.abs(F.col("brightness") - F.col("before"))).filter("change >= 0.05")
    return changed.withColumn("place", F.row_number().over(w)).filter("place <= 32").select("video_path", "frame_id", "place", F.round("change", 6).alias("change"))


@query(f"WITH {_META} SELECT video_path, CAST(greatest(1, ceil(greatest(last_ts - first_ts, 0) / 5.0)) AS INT) AS expected, CAST(greatest(1, ceil(greatest(last_ts - first_ts, 0) / 5.0)) * 2097152 AS BIGINT) AS bytes FROM m")
def estimated_output(spark: SparkSession, d: str) -> DataFrame:
    n = scalars.estimated_count(F.col("last_ts") - F.col("first_ts"), every=5.0)
    return meta(spark, d).select("video_path", n.alias("expected"), (n.cast("long") * 2 * 1024 * 1024).alias("bytes"))


@query(
    f"""WITH RECURSIVE {_CUT_SQL}, ranked AS (
      SELECT s.video_path, s.segment, s.best_ts, f.frame_id, row_number() OVER (PARTITION BY s.video_path, s.segment ORDER BY f.ts, f.frame_id) AS n
      FROM scenes s JOIN f ON f.video_path = s.video_path AND f.ts + 1e-6 >= s.best_ts)
    SELECT video_path, CAST(segment AS INT) AS k, best_ts AS target, frame_id FROM ranked WHERE n = 1"""
)
def cached_scene_replay(spark: SparkSession, d: str) -> DataFrame:
    """Best times found before, looked up again among the frames."""
    cached = streams.detect_cuts(frames(spark, d), "video_path", "ts", "frame_id", "brightness", "sharpness", "motion_blur", CUTS, QUALITY)
    targets = cached.select("video_path", F.col("segment").alias("k"), F.col("best_ts").alias("target"))
    return streams.match_targets(targets, frames(spark, d), "video_path", "ts", "frame_id").select("video_path", "k", "target", "frame_id")


@query(
    f"""WITH {_FRAMES}, r AS (SELECT video_path, greatest(max(ts), 1.0) AS extent FROM f GROUP BY video_path)
    SELECT frame_id, round(least(100.0, greatest(0.0, ts / extent * 100)), 6) AS place FROM f JOIN r USING (video_path)"""
)
def timeline_places(spark: SparkSession, d: str) -> DataFrame:
    """Place of each frame on its timeline in percent; a timeline is at least a second long."""
    f = frames(spark, d)
    extent = f.groupBy("video_path").agg(F.greatest(F.max("ts"), F.lit(1.0)).alias("extent"))
    return f.join(extent, "video_path").select("frame_id", F.round(scalars.percent_of(F.col("ts"), F.lit(0.0), F.col("extent")), 6).alias("place"))


@query(
    r"""WITH x AS (SELECT DISTINCT doc_id, regexp_extract(text, '(\d+\.\d+\.\d+)', 1) AS version FROM documents WHERE regexp_matches(text, '\d+\.\d+\.\d+'))
    SELECT doc_id, version, list_transform(string_split(version, '.'), lambda s: CAST(s AS BIGINT)) > [0, 5, 0] AS newer FROM x"""
)
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"(\d+\.\d+\.\d+)", 1).alias("version")).filter("version <> ''").distinct()
    key = scalars.version_key(F.col("version"))
    first = F.array(*[F.lit(v).cast("long") for v in (0, 5, 0)])
    return x.select("doc_id", "version", (key > first).alias("newer"))


@query(
    r"""WITH r AS (SELECT DISTINCT result_id, coalesce(nullif(replace(trim(regexp_replace(regexp_replace(title, '<[^>]+>', '', 'g'), '^File:', ''), ' '), ' ', '_'), ''), 'image') || '.jpg' AS base FROM image_results),
    k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY result_id) - 1 AS k FROM r)
    SELECT result_id, CASE WHEN k = 0 THEN base ELSE regexp_replace(base, '\.[^.]*$', '') || printf('_%02d', k) || '.jpg' END AS name FROM k"""
)
def unique_file_names(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "image_results").select("result_id", "title").distinct()
    base = F.concat(F.coalesce(F.nullif(scalars.clean_title(F.regexp_replace("title", "<[^>]+>", "")), F.lit("")), F.lit("image")), F.lit(".jpg"))
    return relational.unique_names(r.select("result_id", base.alias("base")), "base", "result_id", "name").select("result_id", "name")


@query(
    f"""WITH h AS (SELECT job_id, position, sha1(unhex('{scalars.URL_NAMESPACE}') || encode('queue:' || job_id || ':' || position)) AS x
      FROM (SELECT DISTINCT job_id, position FROM queue_items WHERE job_id IS NOT NULL AND position IS NOT NULL))
    SELECT job_id, position, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || format('{{:02x}}', (CAST('0x' || x[17:18] AS INT) & 63) | 128) || x[19:20] || '-' || x[21:32] AS stable_id FROM h"""
)
def name_based_ids(spark: SparkSession, d: str) -> DataFrame:
    """An identifier for each place of a job that is the same on every run."""
    q = table(spark, d, "queue_items").filter("job_id IS NOT NULL AND position IS NOT NULL").select("job_id", "position").distinct()
    name = F.concat_ws(":", F.lit("queue"), "job_id", F.col("position").cast("string"))
    return q.select("job_id", "position", scalars.name_based_uuid(scalars.URL_NAMESPACE, name).alias("stable_id"))


@query("SELECT job_id, repeat('•', length(run_signature) - 4) || right(run_signature, 4) AS masked FROM (SELECT DISTINCT job_id, run_signature FROM jobs WHERE length(run_signature) > 4)")
def masked_keys(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").filter(F.length("run_signature") > 4).select("job_id", "run_signature").distinct()
    return j.select("job_id", scalars.mask_key(F.col("run_signature")).alias("masked"))


@query(
    """SELECT doc_id, list_filter([CASE WHEN NOT regexp_matches(coalesce(lang, ''), '^\\d+\\.\\d+\\.\\d+$') THEN 'version' END,
      CASE WHEN NOT starts_with(lower(coalesce(source, '')), 'https://') THEN 'url' END,
      CASE WHEN NOT regexp_matches(sha256(coalesce(text, '')), '^[0-9a-fA-F]{64}$') THEN 'sha256' END], lambda x: x IS NOT NULL) AS faults FROM documents"""
)
def release_faults(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select("doc_id", scalars.release_faults(F.col("lang"), F.col("source"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("faults"))


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL")
def checksums(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").filter("text IS NOT NULL")
    return doc.select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"))


@query("SELECT DISTINCT trim(url, ' ') AS url FROM image_results WHERE trim(coalesce(url, ''), ' ') <> '' ORDER BY url LIMIT 100")
def url_queue(spark: SparkSession, d: str) -> DataFrame:
    """The addresses to fetch: trimmed, no blanks, at most 100 (the limit of one queue)."""
    r = table(spark, d, "image_results").select(F.trim("url").alias("url")).filter("url <> ''")
    return r.distinct().orderBy("url").limit(100)


@query(
    r"""SELECT url FROM (SELECT DISTINCT url, CASE lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) WHEN 'jpg' THEN 0 WHEN 'png' THEN 1 WHEN 'webp' THEN 2 ELSE 3 END AS r FROM image_results WHERE url IS NOT NULL)
    WHERE r < 3 ORDER BY r, url LIMIT 24"""
)
def preview_grid(spark: SparkSession, d: str) -> DataFrame:
    """The first 24 pictures of a preview: jpg, then png, then webp, each by name."""
    suffix = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1))
    rank = F.when(suffix == "jpg", 0).when(suffix == "png", 1).when(suffix == "webp", 2)
    r = table(spark, d, "image_results").filter("url IS NOT NULL").select("url", rank.alias("r")).filter("r IS NOT NULL").distinct()
    return r.orderBy("r", "url").limit(24).select("url")


@query(
    f"""WITH {_LATEST} SELECT item_id, CASE WHEN status = 'completed' THEN 'done' WHEN error IS NOT NULL AND error <> '' THEN 'error' WHEN status IN ('running', 'retrying') AND fraction > 0 THEN 'working'
      WHEN status IN ('running', 'retrying') THEN 'starting' ELSE 'waiting' END AS phase, round(least(1.0, greatest(0.0, coalesce(fraction, 0.0))), 6) AS fraction FROM q"""
)
def item_phases(spark: SparkSession, d: str) -> DataFrame:
    """What to show for each item, from its latest state."""
    active = F.col("status").isin("running", "retrying")
    phase = F.when(F.col("status") == "completed", "done").when(F.coalesce("error", F.lit("")) != "", "error").when(active & (F.col("fraction") > 0), "working").when(active, "starting").otherwise("waiting")
    share = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("fraction", F.lit(0.0)))), 6)
    return latest_states(spark, d).select("item_id", phase.alias("phase"), share.alias("fraction"))


@query(
    """WITH a AS (SELECT job_id, updated_at, state, 0 AS side FROM jobs WHERE schema_version = 1), b AS (SELECT job_id, updated_at, state, 1 AS side FROM jobs WHERE schema_version = 2),
    u AS (SELECT * FROM a UNION SELECT * FROM b)
    SELECT job_id, updated_at, state FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY side DESC, updated_at DESC NULLS LAST, state DESC NULLS LAST) AS k FROM u) WHERE k = 1"""
)
def jobs_of_both_schemas(spark: SparkSession, d: str) -> DataFrame:
    """One list of jobs from tables of two schemas; the newer schema wins."""
    j = table(spark, d, "jobs").filter("schema_version IN (1, 2)")
    u = j.select("job_id", "updated_at", "state", (F.col("schema_version") - 1).alias("side")).distinct()
    return relational.latest(u, ("job_id",), ("side", "updated_at", "state")).select("job_id", "updated_at", "state")


@query(
    """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 17 AS INT) AS c, CAST(o_orderkey % 40 AS DOUBLE) AS m, CAST(1 + o_orderkey % 4 AS INT) AS w, CAST(o_orderkey % 5 AS INT) AS r, CAST(o_orderkey % 400 AS INT) AS n, CAST(o_orderkey % 500 AS DOUBLE) AS s FROM orders)
    SELECT o_orderkey, CASE WHEN n < 8 THEN 1 ELSE greatest(1, least(4, CASE WHEN r > 0 THEN r ELSE 4 END, greatest(1, CAST(ceil(c / w) AS INT)), CASE WHEN m < 8 THEN 1 WHEN m < 16 THEN 2 WHEN m < 32 THEN 3 ELSE 4 END,
      CASE WHEN s < 30 AND n < 96 THEN 1 WHEN s < 90 AND n < 160 THEN 1 WHEN s < 180 AND n < 240 THEN 2 WHEN s < 300 AND n < 360 THEN 3 ELSE 4 END)) END AS workers FROM o"""
)
def worker_budget(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    part = lambda n, t: (F.col("o_orderkey") % n).cast(t)
    return o.select("o_orderkey", scalars.worker_budget(part(17, "int"), part(40, "double"), part(4, "int") + 1, part(5, "int"), part(400, "int"), part(500, "double")).alias("workers"))


@query(
    f"""{_NODES}, stages AS (SELECT unnest(json_keys(j -> 'stage_timings')) AS stage, j -> 'stage_timings' AS s FROM o WHERE json_type(j -> 'stage_timings') = 'OBJECT'),
    t AS (SELECT stage, TRY_CAST(json_extract_string(s -> stage, '$.ms') AS DOUBLE) AS ms, TRY_CAST(json_extract_string(s -> stage, '$.count') AS INT) AS n FROM stages)
    SELECT stage, round(sum(CASE WHEN isnan(ms) THEN 0.0 ELSE ms END), 3) AS ms, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_reports FROM t GROUP BY stage"""
)
def report_stage_timings(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds and counts of each stage over the latest reports, summed before rounding."""
    x = _report_tables(spark, d)["stage_timings"]
    return x.groupBy(F.col("name").alias("stage")).agg(F.round(F.sum(F.nanvl("ms", F.lit(0.0))), 3).alias("ms"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_reports"))


@query(
    f"""{_NODES}, r AS (SELECT TRY_CAST(json_extract_string(j, '$.requested') AS INT) AS requested, TRY_CAST(json_extract_string(j, '$.saved') AS INT) AS saved FROM o)
    SELECT count(*) AS n_reports, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(greatest(coalesce(requested, 0) - coalesce(saved, 0), 0)) AS BIGINT) AS shortfall FROM r"""
)
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    """Saved and missing pictures over the latest reports."""
    missing = F.greatest(F.coalesce("requested", F.lit(0)) - F.coalesce("saved", F.lit(0)), F.lit(0))
    return _report_tables(spark, d)["reports"].agg(F.count(F.lit(1)).alias("n_reports"), F.sum("saved").alias("saved"), F.sum(missing).alias("shortfall"))


def _times(name: str) -> str:
    return f"""(SELECT item_id, k, TRY_CAST(e AS DOUBLE) AS v FROM (SELECT item_id, unnest(range(CAST(json_array_length(j -> '{name}') AS BIGINT))) AS k,
      unnest(CAST(json_extract_string(j -> '{name}', '$[*]') AS VARCHAR[])) AS e FROM o WHERE json_type(j -> '{name}') = 'ARRAY') WHERE TRY_CAST(e AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(e AS DOUBLE)))"""


@query(
    f"""{_NODES}, a AS {_times("scene_times")}, b AS {_times("selected_times")},
    n AS (SELECT a.item_id, a.k, a.v, b.v AS s, row_number() OVER (PARTITION BY a.item_id, a.k ORDER BY abs(b.v - a.v), b.v) AS r FROM a LEFT JOIN b USING (item_id))
    SELECT item_id, CAST(k + 1 AS INT) AS scene, v AS time_seconds, coalesce(s, v) AS representative FROM n WHERE r = 1"""
)
def report_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Each scene time of the reports with the nearest selected time (the scene itself if there are none)."""
    t = _report_tables(spark, d)
    times = lambda name: t[name].filter("value IS NOT NULL AND NOT isnan(value)").withColumnRenamed("record_key", "item_id")
    points = times("scene_times").select("item_id", (F.col("place") + 1).alias("scene"), F.col("value").alias("time_seconds"))
    chosen = times("selected_times").select("item_id", F.col("value").alias("selected"))
    return streams.nearest(points, chosen, "item_id", "time_seconds", "selected").withColumnRenamed("nearest", "representative")


_KINDS = "VALUES " + ", ".join(f"('{s}', '{k}')" for k, ss in scalars.SUFFIX_KINDS.items() for s in ss)


@query(
    rf"""WITH kinds(suffix, kind) AS ({_KINDS}), f AS (SELECT DISTINCT url FROM image_results WHERE url IS NOT NULL),
    x AS (SELECT regexp_extract(lower(url), '(\.[^./]+)$', 1) AS suffix, lower(url) LIKE '%/static/%' AS web FROM f)
    SELECT CASE WHEN web THEN 'frontend_static_asset' ELSE coalesce(kind, 'other') END AS kind, count(*) AS n FROM x LEFT JOIN kinds USING (suffix) GROUP BY 1"""
)
def size_by_category(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "image_results").select("url").filter(F.col("url").isNotNull()).distinct()
    return f.groupBy(scalars.size_category(F.col("url")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
