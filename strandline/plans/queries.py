"""Queries of the core on the test tables, and their SQL.

Each query sits next to the SQL it is compared with; both run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import scalars, vectors
from strandline.operators import nested, ranged, relational, streams
from strandline.session import materialize, table
from strandline.sources import payloads
from strandline.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- nested reports


_NODES = r"""WITH latest AS (
  SELECT item_id, report_json AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC NULLS LAST, report_json DESC NULLS LAST) AS rn FROM queue_items WHERE item_id IS NOT NULL) WHERE rn = 1),
inner_ AS (SELECT item_id, CASE WHEN NOT starts_with(ltrim(t, E' \t\r\n'), '"') THEN t WHEN json_valid(t) THEN json_extract_string(t, '$') END AS t FROM latest),
outer_ AS (SELECT item_id, regexp_replace(t, '([:,\[]\s*)NaN', '\1"NaN"', 'g') AS t FROM inner_),
o AS (SELECT item_id, CAST(t AS JSON) AS j FROM outer_ WHERE json_valid(t) AND json_type(t) = 'OBJECT'),
lists AS (SELECT item_id, 'scenes' AS path, j -> 'scenes' AS x FROM o UNION ALL SELECT item_id, 'attempts_log', j -> 'attempts_log' FROM o),
first AS (SELECT item_id, path || '/' || k AS node, e FROM (
  SELECT item_id, path, unnest(range(CAST(json_array_length(x) AS BIGINT))) AS k, unnest(CAST(x AS JSON[])) AS e FROM lists WHERE json_type(x) = 'ARRAY'
  UNION ALL SELECT item_id, path, 0, x FROM lists WHERE json_type(x) = 'OBJECT') WHERE json_type(e) = 'OBJECT'),
frames AS (SELECT item_id, node || '/frames/' || k AS node, e FROM (
  SELECT item_id, node, unnest(range(CAST(json_array_length(x) AS BIGINT))) AS k, unnest(CAST(x AS JSON[])) AS e FROM (SELECT item_id, node, e -> 'frames' AS x FROM first WHERE starts_with(node, 'scenes/')) WHERE json_type(x) = 'ARRAY'
  UNION ALL SELECT item_id, node, 0, e -> 'frames' FROM first WHERE starts_with(node, 'scenes/') AND json_type(e -> 'frames') = 'OBJECT') WHERE json_type(e) = 'OBJECT'),
rejections AS (SELECT item_id, node || '/rejections/' || k AS node, e FROM (
  SELECT item_id, node, unnest(range(CAST(json_array_length(x) AS BIGINT))) AS k, unnest(CAST(x AS JSON[])) AS e FROM (SELECT item_id, node, e -> 'rejections' AS x FROM frames) WHERE json_type(x) = 'ARRAY'
  UNION ALL SELECT item_id, node, 0, e -> 'rejections' FROM frames WHERE json_type(e -> 'rejections') = 'OBJECT') WHERE json_type(e) = 'OBJECT')"""


@query(f"{_NODES} SELECT item_id, node FROM first UNION ALL SELECT item_id, node FROM frames UNION ALL SELECT item_id, node FROM rejections")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.report_nodes(table(spark, d, "queue_items"))
    return nodes.filter(F.col("table_name").isin(*nested.NESTED_TABLES)).select(F.col("record_key").alias("item_id"), "node")


def _report_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return nested.related_tables(nested.report_nodes(table(spark, d, "queue_items")), nested.REPORT)


def _fields(source: str, kinds: dict[str, str]) -> str:
    types = {"string": None, "int": "INT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    text = lambda f: f"json_extract_string({source}, '$.{f}')"
    return ", ".join(f'{text(f)} AS "{f}"' if types[t] is None else f'TRY_CAST({text(f)} AS {types[t]}) AS "{f}"' for f, t in kinds.items())


def _table_sql(rows: str, kinds: dict[str, str]) -> str:
    return f"""{_NODES} SELECT item_id, node, regexp_replace(node, '/?[^/]+/[0-9]+$', '') AS parent_node,
      CAST(regexp_extract(node, '([0-9]+)$', 1) AS INT) AS place, {_fields("e", kinds)} FROM {rows}"""


_SCENES = nested.REPORT.children[0]
_FRAME = _SCENES.children[1]


@query(f"{_NODES} SELECT item_id, {_fields('j', nested.REPORT.fields)} FROM o")
def p1_reports(spark: SparkSession, d: str) -> DataFrame:
    return _report_tables(spark, d)["reports"].drop("node", "parent_node", "place").withColumnRenamed("record_key", "item_id")


@query(_table_sql("first WHERE starts_with(node, 'scenes/')", _SCENES.fields))
def p1_scenes(spark: SparkSession, d: str) -> DataFrame:
    return _report_tables(spark, d)["scenes"].withColumnRenamed("record_key", "item_id")


@query(_table_sql("frames", _FRAME.fields))
def p1_frames(spark: SparkSession, d: str) -> DataFrame:
    return _report_tables(spark, d)["frames"].withColumnRenamed("record_key", "item_id")


@query(_table_sql("rejections", _FRAME.children[1].fields))
def p1_rejections(spark: SparkSession, d: str) -> DataFrame:
    return _report_tables(spark, d)["rejections"].withColumnRenamed("record_key", "item_id")


@query(_table_sql("first WHERE starts_with(node, 'attempts_log/')", nested.REPORT.children[1].fields))
def p1_attempts(spark: SparkSession, d: str) -> DataFrame:
    return _report_tables(spark, d)["attempts"].withColumnRenamed("record_key", "item_id")


@query(
    f"""{_NODES}, cut AS (SELECT item_id, node, e -> 'cut' AS c FROM first WHERE starts_with(node, 'scenes/') AND json_type(e -> 'cut') = 'OBJECT')
    SELECT item_id, node || '/cut' AS node, node AS parent_node, {_fields("c", {"score": "double", "confirmations": "int"})},
      TRY_CAST(json_extract_string(c, '$.flash.ratio') AS DOUBLE) AS flash_ratio, TRY_CAST(json_extract_string(c, '$.flash.bright') AS DOUBLE) AS flash_bright FROM cut"""
)
def p1_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Each cut with its flash: two linked tables joined by their links."""
    t = _report_tables(spark, d)
    flash = t["flashes"].select("record_key", F.col("parent_node").alias("node"), F.col("ratio").alias("flash_ratio"), F.col("bright").alias("flash_bright"))
    return t["cuts"].drop("place").join(flash, ["record_key", "node"], "left").withColumnRenamed("record_key", "item_id")


@query(
    f"""{_NODES}, stages AS (SELECT item_id, unnest(json_keys(j -> 'stage_timings')) AS name, j -> 'stage_timings' AS s FROM o WHERE json_type(j -> 'stage_timings') = 'OBJECT'),
    timed AS (SELECT name, s -> name AS v FROM stages)
    SELECT name, count(*) AS reports, round(sum(TRY_CAST(json_extract_string(v, '$.ms') AS DOUBLE)), 3) AS ms, CAST(sum(TRY_CAST(json_extract_string(v, '$.count') AS INT)) AS BIGINT) AS "count" FROM timed GROUP BY name"""
)
def p1_stage_timings(spark: SparkSession, d: str) -> DataFrame:
    timings = _report_tables(spark, d)["stage_timings"]
    return timings.groupBy("name").agg(F.count(F.lit(1)).alias("reports"), F.round(F.sum("ms"), 3).alias("ms"), F.sum("count").alias("count"))


@query(
    f"""{_NODES}, e AS (SELECT item_id, node, e -> 'error' AS x FROM first WHERE starts_with(node, 'attempts_log/') AND json_type(e -> 'error') = 'OBJECT')
    SELECT json_extract_string(x, '$.code') AS code, json_extract_string(x, '$.cause.kind') AS cause, count(*) AS n,
      CAST(sum(CASE WHEN json_type(x -> '$.cause.trace') = 'ARRAY' THEN json_array_length(x -> '$.cause.trace') ELSE 0 END) AS BIGINT) AS trace_lines FROM e GROUP BY ALL"""
)
def p1_error_causes(spark: SparkSession, d: str) -> DataFrame:
    """Errors of attempts by code and kind of cause, over three levels of linked tables."""
    t = _report_tables(spark, d)
    lines = t["trace"].groupBy("record_key", F.col("parent_node").alias("cause_node")).agg(F.count(F.lit(1)).alias("lines"))
    causes = t["causes"].select("record_key", F.col("node").alias("cause_node"), F.col("parent_node").alias("node"), F.col("kind").alias("cause")).join(lines, ["record_key", "cause_node"], "left")
    joined = t["errors"].join(causes, ["record_key", "node"], "left")
    return joined.groupBy("code", "cause").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("lines", F.lit(0))).alias("trace_lines"))


# ---------------------------------------------------------------- frames

QUALITY = streams.Quality(100.0, 0.30, 6)
CUTS = streams.CutRule(threshold=0.08, flash_brightness=0.05)
STEP_MS, FPS, QUOTA, LIMIT = 5000, 1.0, 20, 10

_FRAMES = """f AS (
  SELECT DISTINCT video_path, ts, frame_id, sharpness, motion_blur, brightness, hash_value
  FROM frame_candidates WHERE video_path IS NOT NULL)"""
_META = f"""{_FRAMES}, m AS (
  SELECT video_path, count(*) AS frame_count, min(ts) AS first_ts, max(ts) AS last_ts FROM f GROUP BY video_path)"""
_STATUS = """CASE WHEN sharpness < 100 AND NOT isnan(sharpness) THEN 'blurry' WHEN motion_blur > 0.30 THEN 'motion_blur' ELSE 'ok' END"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "frame_candidates").filter(F.col("video_path").isNotNull())
    return f.select("video_path", "ts", "frame_id", "sharpness", "motion_blur", "brightness", "hash_value").distinct()


def meta(spark: SparkSession, d: str) -> DataFrame:
    return streams.stream_meta(frames(spark, d), "video_path", "ts")


@query(
    f"""WITH {_META} SELECT video_path, frame_count, first_ts, last_ts, round(last_ts - first_ts, 6) AS duration,
    round(CASE WHEN last_ts > first_ts THEN frame_count / (last_ts - first_ts) ELSE 30.0 END, 6) AS fps FROM m"""
)
def stream_meta(spark: SparkSession, d: str) -> DataFrame:
    return meta(spark, d)


_GRID = f"""{_META}, grid AS (
  SELECT video_path, CAST(k AS INT) AS k, round(first_ts + k * 5.0, 6) AS target
  FROM m, LATERAL (SELECT unnest(range(CAST(greatest(ceil((last_ts - first_ts) / 5.0 - 1e-6), 0) AS BIGINT))) AS k))"""


@query(f"WITH {_GRID} SELECT * FROM grid")
def interval_targets(spark: SparkSession, d: str) -> DataFrame:
    return streams.interval_targets(meta(spark, d), "video_path", F.col("first_ts"), F.col("last_ts"), STEP_MS)


_EVEN = "round(first_ts + (greatest(first_ts, last_ts - 0.1) - first_ts) * k / {n}, 6)"


@query(f"WITH {_META} SELECT video_path, CAST(k AS INT) AS k, {_EVEN.format(n=4)} AS target FROM m, range(5) r(k)")
def count_targets(spark: SparkSession, d: str) -> DataFrame:
    return streams.count_targets(meta(spark, d), "video_path", F.col("first_ts"), F.col("last_ts"), 5)


@query(
    f"""WITH {_META}, n AS (SELECT *, ceil((last_ts - first_ts) / 5.0 - 1e-6) AS ticks FROM m)
    SELECT video_path, CAST(k AS INT) AS k, round(first_ts + k * 5.0, 6) AS target FROM n, range(10) r(k) WHERE ticks >= 10
    UNION ALL SELECT video_path, CAST(k AS INT), {_EVEN.format(n=9)} FROM n, range(10) r(k) WHERE ticks < 10 AND last_ts > first_ts"""
)
def short_refill(spark: SparkSession, d: str) -> DataFrame:
    return streams.short_refill(meta(spark, d), "video_path", F.col("first_ts"), F.col("last_ts"), STEP_MS, LIMIT)


@query(
    f"""WITH {_GRID}, hit AS (
      SELECT g.video_path, g.k, g.target, h.ts, row_number() OVER (PARTITION BY g.video_path, g.k ORDER BY h.ts, h.frame_id) AS n, h.frame_id
      FROM grid g LEFT JOIN f h ON g.video_path = h.video_path AND h.ts + 1e-6 >= g.target)
    SELECT video_path, k, target, frame_id, round(ts, 6) AS ts FROM hit WHERE n = 1"""
)
def asof_target_match(spark: SparkSession, d: str) -> DataFrame:
    grid = streams.interval_targets(meta(spark, d), "video_path", F.col("first_ts"), F.col("last_ts"), STEP_MS)
    return streams.match_targets(grid, frames(spark, d), "video_path", "ts", "frame_id")


@query(
    f"""WITH RECURSIVE {_META}, t AS MATERIALIZED (
      SELECT video_path, CAST(k AS INT) AS k, round(first_ts + k * 0.5, 6) AS target
      FROM m, LATERAL (SELECT unnest(range(CAST(greatest(ceil((last_ts - first_ts) / 0.5 - 1e-6), 0) AS BIGINT))) AS k)),
    o AS MATERIALIZED (SELECT video_path, ts, frame_id, row_number() OVER (PARTITION BY video_path ORDER BY ts, frame_id) AS n FROM f),
    go AS (
      SELECT t.video_path, t.k, t.target, min(o.n) AS n FROM t JOIN o ON o.video_path = t.video_path AND o.ts + 1e-6 >= t.target
      WHERE t.k = 0 GROUP BY ALL
      UNION ALL
      SELECT t.video_path, t.k, t.target, (SELECT min(o.n) FROM o WHERE o.video_path = t.video_path AND o.n > go.n AND o.ts + 1e-6 >= t.target) AS n
      FROM go JOIN t ON t.video_path = go.video_path AND t.k = go.k + 1 WHERE go.n IS NOT NULL)
    SELECT go.video_path, k, target, o.frame_id, o.ts FROM go JOIN o ON o.video_path = go.video_path AND o.n = go.n"""
)
def greedy_target_match(spark: SparkSession, d: str) -> DataFrame:
    grid = streams.interval_targets(meta(spark, d), "video_path", F.col("first_ts"), F.col("last_ts"), 500)
    return streams.match_targets_greedy(grid, frames(spark, d), "video_path", "ts", "frame_id")


_ORDERED = f"""{_FRAMES}, o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY video_path ORDER BY ts, frame_id) AS n, {_STATUS} AS quality FROM f)"""


@query(
    f"""WITH RECURSIVE {_ORDERED}, go AS (
      SELECT video_path, n, ts, frame_id, true AS kept, ts + 1.0 AS due FROM o WHERE n = 1
      UNION ALL
      SELECT o.video_path, o.n, o.ts, o.frame_id, o.ts + 1e-6 >= go.due, CASE WHEN o.ts + 1e-6 >= go.due THEN o.ts + 1.0 ELSE go.due END
      FROM go JOIN o ON o.video_path = go.video_path AND o.n = go.n + 1)
    SELECT video_path, ts, frame_id FROM go WHERE kept"""
)
def rate_limited_sample(spark: SparkSession, d: str) -> DataFrame:
    return streams.rate_limited(frames(spark, d), "video_path", "ts", "frame_id", FPS)


@query(
    f"""WITH {_FRAMES} SELECT video_path, frame_id, round(abs(brightness - lag(brightness) OVER w), 6) AS brightness_change,
    CAST(bit_count(xor(hash_value, lag(hash_value) OVER w)) AS INT) AS bits_changed, round(ts - lag(ts) OVER w, 6) AS gap
    FROM f WINDOW w AS (PARTITION BY video_path ORDER BY ts, frame_id)"""
)
def neighbour_change(spark: SparkSession, d: str) -> DataFrame:
    return streams.neighbour_change(frames(spark, d), "video_path", "ts", "frame_id", "brightness", "hash_value")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).withColumn("quality", streams.quality_status(F.col("sharpness"), F.col("motion_blur"), QUALITY))


@query(f"WITH {_FRAMES} SELECT frame_id, {_STATUS} AS quality FROM f")
def quality_status(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("frame_id", "quality")


def _decided(spark: SparkSession, d: str, everywhere: bool, carry: dict[str, str] | None = None) -> DataFrame:
    return streams.accept(_judged(spark, d), "video_path", "ts", "frame_id", "hash_value", "quality", QUALITY.max_hash_bits, everywhere, carry)


_CONSECUTIVE = f"""{_ORDERED}, go AS (
  SELECT video_path, n, frame_id, CASE WHEN quality = 'ok' THEN 'saved' ELSE quality END AS status,
         CASE WHEN quality = 'ok' THEN hash_value END AS last_hash FROM o WHERE n = 1
  UNION ALL
  SELECT o.video_path, o.n, o.frame_id,
    CASE WHEN o.quality <> 'ok' THEN o.quality WHEN bit_count(xor(o.hash_value, go.last_hash)) <= 6 THEN 'duplicate' ELSE 'saved' END,
    CASE WHEN o.quality <> 'ok' OR o.hash_value IS NULL OR bit_count(xor(o.hash_value, go.last_hash)) <= 6 THEN go.last_hash ELSE o.hash_value END
  FROM go JOIN o ON o.video_path = go.video_path AND o.n = go.n + 1)"""

_GLOBAL = f"""{_ORDERED}, go AS (
  SELECT video_path, n, frame_id, CASE WHEN quality = 'ok' THEN 'saved' ELSE quality END AS status,
         CASE WHEN quality = 'ok' THEN hash_value END AS last_hash,
         CASE WHEN quality = 'ok' AND hash_value IS NOT NULL THEN [hash_value] ELSE CAST([] AS BIGINT[]) END AS seen FROM o WHERE n = 1
  UNION ALL
  SELECT video_path, n, frame_id, status, CASE WHEN status = 'saved' AND h IS NOT NULL THEN h ELSE last_hash END,
         CASE WHEN status = 'saved' AND h IS NOT NULL THEN list_append(seen, h) ELSE seen END
  FROM (SELECT o.video_path, o.n, o.frame_id, o.hash_value AS h, go.last_hash, go.seen,
      CASE WHEN o.quality <> 'ok' THEN o.quality WHEN bit_count(xor(o.hash_value, go.last_hash)) <= 6 THEN 'duplicate'
           WHEN o.hash_value IS NOT NULL AND len(list_filter(go.seen, lambda s: bit_count(xor(s, o.hash_value)) <= 6)) > 0 THEN 'duplicate_global'
           ELSE 'saved' END AS status
    FROM go JOIN o ON o.video_path = go.video_path AND o.n = go.n + 1))"""


@query(f"WITH RECURSIVE {_CONSECUTIVE} SELECT video_path, frame_id, status FROM go")
def dedup_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d, False)


@query(f"WITH RECURSIVE {_GLOBAL} SELECT video_path, frame_id, status FROM go")
def dedup_global(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d, True)


STATUSES = ("saved", "blurry", "motion_blur", "duplicate", "duplicate_global")
_REPORT = f"""{_CONSECUTIVE}, r AS (
  SELECT video_path, count(*) AS considered, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES)} FROM go GROUP BY video_path)"""


def _report(spark: SparkSession, d: str) -> DataFrame:
    return relational.status_counts(_decided(spark, d, False), "video_path", STATUSES)


@query(f"WITH RECURSIVE {_REPORT} SELECT * FROM r")
def stream_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


@query(
    f"""WITH RECURSIVE {_REPORT} SELECT count(*) AS videos, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(blurry) AS BIGINT) AS blurry,
    CAST(sum(motion_blur) AS BIGINT) AS motion_blur, CAST(sum(duplicate) AS BIGINT) AS duplicate,
    CAST(sum(greatest(20 - saved, 0)) AS BIGINT) AS shortfall FROM r"""
)
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).agg(
        F.count(F.lit(1)).alias("videos"),
        *[F.sum(s).alias(s) for s in ("saved", "blurry", "motion_blur", "duplicate")],
        F.sum(F.greatest(QUOTA - F.col("saved"), F.lit(0))).alias("shortfall"),
    )


@query(
    f"""WITH RECURSIVE {_REPORT} SELECT video_path, greatest(20 - saved, 0) AS shortfall,
    CASE WHEN saved >= 20 THEN 'reached' WHEN saved + blurry + motion_blur + duplicate >= 20 THEN 'can be filled' ELSE 'too few frames' END AS verdict,
    list_sort(list_filter([CASE WHEN blurry > 0 THEN 'blurry' END, CASE WHEN motion_blur > 0 THEN 'motion_blur' END, CASE WHEN duplicate > 0 THEN 'duplicate' END],
      lambda x: x IS NOT NULL)) AS reasons FROM r"""
)
def shortfall(spark: SparkSession, d: str) -> DataFrame:
    missing = F.greatest(QUOTA - F.col("saved"), F.lit(0).cast("long"))
    reasons = F.array(*[F.when(F.col(s) > 0, F.lit(s)) for s in ("blurry", "motion_blur", "duplicate")])
    verdict = F.when(F.col("saved") >= QUOTA, "reached").when(F.expr("saved + blurry + motion_blur + duplicate") >= QUOTA, "can be filled").otherwise("too few frames")
    return _report(spark, d).select("video_path", missing.alias("shortfall"), verdict.alias("verdict"), F.array_sort(F.filter(reasons, lambda x: x.isNotNull())).alias("reasons"))


@query(
    f"""WITH RECURSIVE {_CONSECUTIVE}, x AS (
      SELECT go.video_path, go.frame_id, go.status, f.ts, CASE WHEN f.sharpness IS NULL OR isnan(f.sharpness) THEN 0.0 ELSE f.sharpness END AS s,
        CASE go.status WHEN 'duplicate_global' THEN 0 WHEN 'duplicate' THEN 1 WHEN 'motion_blur' THEN 2 WHEN 'blurry' THEN 3 ELSE 5 END AS rank
      FROM go JOIN f USING (frame_id)),
    saved AS (SELECT video_path, count(*) FILTER (status = 'saved') AS saved FROM x GROUP BY video_path),
    one AS (SELECT *, row_number() OVER (PARTITION BY video_path, round(ts, 3) ORDER BY rank, s DESC, ts, frame_id) AS k FROM x WHERE status <> 'saved'),
    placed AS (SELECT *, row_number() OVER (PARTITION BY video_path ORDER BY rank, s DESC, ts, frame_id) AS place FROM one WHERE k = 1)
    SELECT video_path, CAST(place AS INT) AS place, frame_id, status AS reason FROM placed JOIN saved USING (video_path) WHERE place <= 20 - saved"""
)
def force_fill(spark: SparkSession, d: str) -> DataFrame:
    decided = _decided(spark, d, False, {"ts": "ts", "sharpness": "sharpness"})
    return streams.force_fill(decided, "video_path", "ts", "frame_id", "sharpness", QUOTA)


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return streams.detect_cuts(frames(spark, d), "video_path", "ts", "frame_id", "brightness", "sharpness", "motion_blur", CUTS, QUALITY)


# State of the detector in columns: the best row so far (b*), the waiting cut (p*), the level before, the last cut.
_CUT_SQL = f"""{_FRAMES}, o AS MATERIALIZED (
  SELECT video_path, ts, frame_id, brightness AS lv, coalesce(CASE WHEN isnan(sharpness) THEN 0.0 ELSE sharpness END, 0.0) AS sh, coalesce(motion_blur, 0.0) <= 0.30 AS ok,
    row_number() OVER (PARTITION BY video_path ORDER BY ts, frame_id) AS n FROM f WHERE brightness IS NOT NULL AND ts IS NOT NULL),
go AS (
  SELECT video_path, n, lv AS prev, frame_id AS b, ts AS bt, sh AS bs, ok AS bok,
    CAST(NULL AS BIGINT) AS p, CAST(NULL AS DOUBLE) AS pt, CAST(NULL AS DOUBLE) AS ps, CAST(NULL AS BOOLEAN) AS pok, CAST(NULL AS DOUBLE) AS pbefore, 0 AS pn,
    ts - 0.5 AS last_cut, 0 AS seg, CAST(NULL AS DOUBLE) AS cut,
    CAST(NULL AS INT) AS eseg, CAST(NULL AS DOUBLE) AS ecut, CAST(NULL AS BIGINT) AS eb, CAST(NULL AS DOUBLE) AS ebt
  FROM o WHERE n = 1
  UNION ALL
  SELECT video_path, n, CASE WHEN act = 'wait' THEN prev ELSE lv END,
    CASE WHEN act = 'commit' THEN CASE WHEN cbetter THEN frame_id ELSE p END WHEN act IN ('flash', 'plain') AND xbetter THEN frame_id ELSE b END,
    CASE WHEN act = 'commit' THEN CASE WHEN cbetter THEN ts ELSE pt END WHEN act IN ('flash', 'plain') AND xbetter THEN ts ELSE bt END,
    CASE WHEN act = 'commit' THEN CASE WHEN cbetter THEN sh ELSE ps END WHEN act IN ('flash', 'plain') AND xbetter THEN sh ELSE bs END,
    CASE WHEN act = 'commit' THEN CASE WHEN cbetter THEN ok ELSE pok END WHEN act IN ('flash', 'plain') AND xbetter THEN ok ELSE bok END,
    CASE WHEN act = 'open' THEN frame_id WHEN act = 'wait' THEN p END, CASE WHEN act = 'open' THEN ts WHEN act = 'wait' THEN pt END,
    CASE WHEN act = 'open' THEN sh WHEN act = 'wait' THEN ps END, CASE WHEN act = 'open' THEN ok WHEN act = 'wait' THEN pok END,
    CASE WHEN act = 'open' THEN prev WHEN act = 'wait' THEN pbefore END, CASE WHEN act = 'open' THEN 1 WHEN act = 'wait' THEN pn + 1 ELSE 0 END,
    CASE WHEN act = 'commit' THEN pt ELSE last_cut END, CASE WHEN act = 'commit' THEN seg + 1 ELSE seg END, CASE WHEN act = 'commit' THEN pt ELSE cut END,
    CASE WHEN act = 'commit' THEN seg END, CASE WHEN act = 'commit' THEN cut END, CASE WHEN act = 'commit' THEN b END, CASE WHEN act = 'commit' THEN bt END
  FROM (SELECT o.video_path, o.n, o.ts, o.frame_id, o.lv, o.sh, o.ok, go.prev, go.b, go.bt, go.bs, go.bok, go.p, go.pt, go.ps, go.pok, go.pbefore, go.pn, go.last_cut, go.seg, go.cut,
      CASE WHEN go.bok <> o.ok THEN o.ok ELSE o.sh > go.bs END AS xbetter, CASE WHEN go.pok <> o.ok THEN o.ok ELSE o.sh > go.ps END AS cbetter,
      CASE WHEN go.p IS NOT NULL THEN CASE WHEN abs(o.lv - go.pbefore) <= CAST({CUTS.threshold * CUTS.flash_ratio!r} AS DOUBLE) AND abs(o.lv - go.pbefore) <= {CUTS.flash_brightness} THEN 'flash' WHEN go.pn + 1 < 2 THEN 'wait' ELSE 'commit' END
           WHEN abs(o.lv - go.prev) >= {CUTS.threshold} AND o.ts - go.last_cut >= 0.5 THEN 'open' ELSE 'plain' END AS act
    FROM go JOIN o ON o.video_path = go.video_path AND o.n = go.n + 1)),
last AS (SELECT *, row_number() OVER (PARTITION BY video_path ORDER BY n DESC) AS z, CASE WHEN p IS NOT NULL AND (CASE WHEN bok <> pok THEN pok ELSE ps > bs END) THEN true ELSE false END AS pbetter FROM go),
scenes AS (
  SELECT video_path, eseg AS segment, ecut AS cut, eb AS best_frame_id, ebt AS best_ts FROM go WHERE eb IS NOT NULL
  UNION ALL SELECT video_path, seg, cut, CASE WHEN pbetter THEN p ELSE b END, CASE WHEN pbetter THEN pt ELSE bt END FROM last WHERE z = 1)"""


@query(f"WITH RECURSIVE {_CUT_SQL} SELECT * FROM scenes")
def scene_report(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d)


@query(
    f"""WITH RECURSIVE {_CUT_SQL} SELECT f.video_path, f.frame_id, CAST(count(s.cut) AS INT) AS segment
    FROM f LEFT JOIN scenes s ON s.video_path = f.video_path AND s.cut <= f.ts GROUP BY f.video_path, f.frame_id"""
)
def segment_ids(spark: SparkSession, d: str) -> DataFrame:
    return streams.segment_ids(frames(spark, d), _cuts(spark, d), "video_path", "ts", "frame_id")


_TIMELINE = f"""{_CUT_SQL}, t AS (
  SELECT s.video_path, s.segment + 1 AS scene, coalesce(s.cut, m.first_ts) AS time_seconds
  FROM scenes s JOIN (SELECT video_path, min(ts) AS first_ts FROM f GROUP BY video_path) m USING (video_path)),
near AS (
  SELECT t.*, c.best_ts, row_number() OVER (PARTITION BY t.video_path, t.scene ORDER BY abs(c.best_ts - t.time_seconds), c.best_ts) AS k
  FROM t JOIN scenes c USING (video_path)),
timeline AS (SELECT video_path, CAST(scene AS INT) AS scene, time_seconds, round(best_ts, 3) AS representative FROM near WHERE k = 1)"""


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    scenes = materialize(_cuts(spark, d), "scenes")
    first = meta(spark, d).select("video_path", "first_ts")
    points = scenes.join(first, "video_path").select("video_path", (F.col("segment") + 1).alias("scene"), F.coalesce("cut", "first_ts").alias("time_seconds"))
    out = streams.nearest(points, scenes, "video_path", "time_seconds", "best_ts")
    return out.select("video_path", "scene", "time_seconds", F.round("nearest", 3).alias("representative"))


@query(f"WITH RECURSIVE {_TIMELINE} SELECT * FROM timeline")
def timeline_build(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d)


@query(
    f"""WITH RECURSIVE {_TIMELINE} SELECT * FROM timeline
    WHERE contains(lower(video_path || ' scene ' || scene), 'wildlife') AND time_seconds BETWEEN 0 AND 60"""
)
def timeline_filter(spark: SparkSession, d: str) -> DataFrame:
    label = F.lower(F.concat_ws(" scene ", "video_path", F.col("scene").cast("string")))
    return _timeline(spark, d).filter(label.contains("wildlife") & F.col("time_seconds").between(0, 60))


@query(
    f"""WITH {_FRAMES}, h AS (SELECT video_path, hash_value, count(*) AS n FROM f WHERE hash_value IS NOT NULL AND hash_value <> 0 GROUP BY ALL)
    SELECT a.video_path, a.hash_value AS hash_a, b.hash_value AS hash_b, a.n AS n_a, b.n AS n_b, CAST(bit_count(xor(a.hash_value, b.hash_value)) AS INT) AS bits
    FROM h a JOIN h b ON a.video_path = b.video_path AND a.hash_value < b.hash_value AND bit_count(xor(a.hash_value, b.hash_value)) <= 6"""
)
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return relational.near_pairs(frames(spark, d).filter("hash_value <> 0"), "video_path", "hash_value", 6)


@query(
    f"""WITH {_FRAMES} SELECT CAST(o AS INT) AS "offset", CAST((hash_value >> (8 * o)) & 255 AS INT) AS byte, count(DISTINCT hash_value) AS n
    FROM f, range(8) r(o) WHERE hash_value IS NOT NULL GROUP BY ALL"""
)
def hash_buckets(spark: SparkSession, d: str) -> DataFrame:
    h = frames(spark, d).filter(F.col("hash_value").isNotNull()).select("hash_value").distinct()
    return h.select(F.inline(vectors.bucket_keys(F.col("hash_value")))).groupBy("offset", "byte").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT video_path, CAST(count(DISTINCT hash_value) AS BIGINT) AS n_hashes FROM frame_candidates
    WHERE video_path IS NOT NULL AND hash_value IS NOT NULL AND hash_value <> 0 GROUP BY video_path"""
)
def dup_index_union(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).filter("hash_value <> 0").select("video_path", "hash_value")
    return f.union(f).distinct().groupBy("video_path").agg(F.count(F.lit(1)).alias("n_hashes"))


# ---------------------------------------------------------------- vectors

_PAIR = """v AS (SELECT label, vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)"""
_PIX = "list_sum(list_transform(list_zip(a, b), lambda x: abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) / len(a)"
_X, _Y = "CAST(a AS DOUBLE[])", "CAST(b AS DOUBLE[])"
_HIST = f"""CASE WHEN b IS NOT NULL THEN least(greatest((1 - (len(a) * list_sum(list_transform(list_zip({_X}, {_Y}), lambda x: x[1] * x[2])) - list_sum({_X}) * list_sum({_Y}))
  / sqrt((len(a) * list_sum(list_transform({_X}, lambda x: x * x)) - list_sum({_X}) ** 2) * (len(a) * list_sum(list_transform({_Y}, lambda x: x * x)) - list_sum({_Y}) ** 2))) / 2, 0), 1) END"""


@query(
    f"""WITH {_PAIR} SELECT label, vec_id, round({_PIX}, 6) AS pixel, round({_HIST}, 6) AS histogram,
    round(coalesce(0.70 * ({_PIX}) + 0.30 * ({_HIST}), 0.0), 6) AS distance FROM v"""
)
def scene_distance(spark: SparkSession, d: str) -> DataFrame:
    v = ranged.previous(table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("a")), "label", [F.asc("vec_id")], b=F.col("a"))
    pixel, histogram = vectors.pixel_difference(F.col("a"), F.col("b")), F.when(F.col("b").isNotNull(), vectors.histogram_difference(F.col("a"), F.col("b")))
    return v.select("label", "vec_id", F.round(pixel, 6).alias("pixel"), F.round(histogram, 6).alias("histogram"), F.round(vectors.scene_distance(pixel, histogram), 6).alias("distance"))


@query(
    """SELECT vec_id, CAST(list_sum(list_transform(range(56), lambda i:
      CASE WHEN embedding[(i // 7) * 8 + i % 7 + 2] > embedding[(i // 7) * 8 + i % 7 + 1] THEN 1::BIGINT << (55 - i)::INT ELSE 0 END)) AS BIGINT) AS hash,
    round(list_sum(CAST(embedding AS DOUBLE[])) / 64, 6) AS brightness FROM embeddings"""
)
def difference_hash(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", vectors.difference_hash(F.col("embedding"), 8, 8).alias("hash"), F.round(vectors.mean(F.col("embedding")), 6).alias("brightness"))


# ---------------------------------------------------------------- queue and states

_LATEST = """q AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY observed_at DESC NULLS LAST, attempts DESC NULLS LAST, status DESC) AS rn FROM item_states) WHERE rn = 1)"""


def latest_states(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "item_states").select("item_id", "observed_at", "attempts", "status", "job_id", "video_path", "fraction", "saved", "started_at", "finished_at", "error", "message")
    return relational.latest(s, ("item_id",), ("observed_at", "attempts", "status"))


@query(f"WITH {_LATEST} SELECT item_id, observed_at, attempts, status FROM q")
def queue_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_states(spark, d).select("item_id", "observed_at", "attempts", "status")


_ACTIVE = "('running', 'retrying')"


@query(
    f"""WITH {_LATEST} SELECT job_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status IN {_ACTIVE}) AS active, count(*) FILTER (status IN ('queued', 'paused')) AS queued,
    round(count(*) FILTER (status = 'completed') / count(*), 6) AS fraction FROM q GROUP BY job_id"""
)
def queue_snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    counts = {"completed": s == "completed", "failed": s == "failed", "cancelled": s == "cancelled", "active": s.isin("running", "retrying"), "queued": s.isin("queued", "paused")}
    out = latest_states(spark, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    return out.withColumn("fraction", F.round(F.col("completed") / F.col("total"), 6))


_JOBS = "j AS (SELECT DISTINCT * FROM jobs)"


@query(
    f"""WITH {_JOBS}, l AS (SELECT job_id, max(heartbeat_at) AS last_heartbeat FROM j WHERE state IN ('running', 'queued') GROUP BY job_id)
    SELECT job_id, last_heartbeat FROM l WHERE last_heartbeat < (SELECT max(heartbeat_at) FROM j) - 300"""
)
def stale_jobs(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs")
    now = j.agg(F.max("heartbeat_at").alias("now"))
    last = j.filter(F.col("state").isin("running", "queued")).groupBy("job_id").agg(F.max("heartbeat_at").alias("last_heartbeat"))
    return last.filter(F.col("last_heartbeat") < now.scalar() - 300)


@query(
    f"""WITH {_LATEST} SELECT item_id, status, CASE WHEN status IN {_ACTIVE} THEN 'interrupted' ELSE status END AS after_crash,
    CASE WHEN status IN {_ACTIVE} OR status = 'interrupted' THEN 'queued' ELSE status END AS after_resume FROM q"""
)
def crash_recovery(spark: SparkSession, d: str) -> DataFrame:
    crashed = F.when(F.col("status").isin("running", "retrying"), "interrupted").otherwise(F.col("status"))
    return latest_states(spark, d).select("item_id", "status", crashed.alias("after_crash"), F.when(crashed == "interrupted", "queued").otherwise(crashed).alias("after_resume"))


@query(
    """WITH s AS (SELECT DISTINCT item_id, status, observed_at, attempts FROM item_states WHERE status IS NOT NULL AND observed_at IS NOT NULL),
    t AS (SELECT item_id, status, lag(status) OVER (PARTITION BY item_id ORDER BY observed_at, attempts, status) AS before FROM s)
    SELECT before, status AS after, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY ALL"""
)
def state_changes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "item_states").select("item_id", "status", "observed_at", "attempts").filter("status IS NOT NULL AND observed_at IS NOT NULL").distinct()
    t = ranged.previous(s, "item_id", [F.asc("observed_at"), F.asc("attempts"), F.asc("status")], before=F.col("status")).filter(F.col("before").isNotNull())
    return t.groupBy("before", F.col("status").alias("after")).agg(F.count(F.lit(1)).alias("n"))


_QLAST = """ql AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC NULLS LAST, attempts DESC NULLS LAST, status DESC) AS rn FROM queue_items) WHERE rn = 1)"""


def latest_items(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queue_items").select("item_id", "updated_at", "attempts", "status", "job_id", "position", "video_path", "error", "progress", "phase")
    return relational.latest(q, ("item_id",), ("updated_at", "attempts", "status"))


@query(f"WITH {_QLAST} SELECT item_id, job_id, position FROM ql WHERE status NOT IN ('completed') AND item_id NOT IN (SELECT item_id FROM item_states WHERE status = 'completed')")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "item_states").filter("status = 'completed'").select("item_id")
    return latest_items(spark, d).filter("status <> 'completed'").join(done, "item_id", "left_anti").select("item_id", "job_id", "position")


@query(
    f"""WITH {_QLAST}, p AS (SELECT job_id, list(video_path ORDER BY position, item_id) AS paths FROM ql WHERE video_path IS NOT NULL GROUP BY job_id),
    x AS (SELECT job_id, run_signature, max(updated_at) AS updated_at FROM jobs GROUP BY ALL)
    SELECT x.job_id, x.run_signature, CAST(len(p.paths) AS INT) AS n_paths FROM x JOIN p USING (job_id)
    QUALIFY row_number() OVER (PARTITION BY run_signature, paths ORDER BY updated_at DESC NULLS LAST, job_id) = 1"""
)
def resume_candidates(spark: SparkSession, d: str) -> DataFrame:
    listed = latest_items(spark, d).filter("video_path IS NOT NULL").groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("position", "item_id", "video_path"))).alias("_l"))
    paths = listed.select("job_id", F.transform("_l", lambda x: x["video_path"]).alias("paths"))
    x = table(spark, d, "jobs").groupBy("job_id", "run_signature").agg(F.max("updated_at").alias("updated_at")).join(paths, "job_id")
    w = Window.partitionBy("run_signature", F.sha2(F.to_json("paths"), 256)).orderBy(F.desc_nulls_last("updated_at"), "job_id")
    return x.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("job_id", "run_signature", F.size("paths").alias("n_paths"))


@query(
    """WITH s AS (SELECT job_id, max(updated_at) AS updated_at FROM jobs WHERE state IN ('queued', 'running', 'interrupted') GROUP BY job_id)
    SELECT job_id, updated_at FROM s WHERE job_id IN (SELECT job_id FROM queue_items WHERE video_path IN (SELECT video_path FROM frame_candidates))
    ORDER BY updated_at DESC NULLS LAST, job_id LIMIT 10"""
)
def recoverable_top10(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").filter(F.col("state").isin("queued", "running", "interrupted")).groupBy("job_id").agg(F.max("updated_at").alias("updated_at"))
    there = table(spark, d, "frame_candidates").select("video_path")
    alive = table(spark, d, "queue_items").join(there, "video_path", "left_semi").select("job_id")
    return jobs.join(alive, "job_id", "left_semi").orderBy(F.desc_nulls_last("updated_at"), "job_id").limit(10)


@query(
    """WITH a AS (SELECT DISTINCT video_path FROM queue_items WHERE video_path IS NOT NULL), b AS (SELECT DISTINCT video_path FROM frame_candidates WHERE video_path IS NOT NULL)
    SELECT video_path, 'missing' AS difference FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT video_path, 'unexpected' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).select("video_path").filter("video_path IS NOT NULL") for t in ("queue_items", "frame_candidates"))
    return relational.list_difference(a, b, "video_path")


@query(
    """WITH a AS (SELECT video_path, max(batch_id) AS stamp FROM frame_candidates WHERE batch_id <= 12 AND video_path IS NOT NULL GROUP BY 1),
    b AS (SELECT video_path, max(batch_id) AS stamp FROM frame_candidates WHERE video_path IS NOT NULL GROUP BY 1)
    SELECT b.video_path, CASE WHEN a.video_path IS NULL THEN 'new' ELSE 'changed' END AS change FROM b LEFT JOIN a USING (video_path) WHERE a.stamp IS NULL OR a.stamp <> b.stamp"""
)
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "frame_candidates").filter("video_path IS NOT NULL")
    stamp = lambda x: x.groupBy("video_path").agg(F.max("batch_id").alias("stamp"))
    return relational.changed(stamp(f.filter("batch_id <= 12")), stamp(f), "video_path", "stamp")


@query(
    f"""WITH {_LATEST} SELECT status, count(*) AS n, round(avg(finished_at - started_at), 4) AS mean_seconds, round(max(finished_at - started_at), 4) AS most_seconds,
    CAST(sum(saved) AS BIGINT) AS saved FROM q WHERE started_at IS NOT NULL AND finished_at IS NOT NULL GROUP BY status"""
)
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    took = F.col("finished_at") - F.col("started_at")
    return (
        latest_states(spark, d)
        .filter("started_at IS NOT NULL AND finished_at IS NOT NULL")
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(took), 4).alias("mean_seconds"), F.round(F.max(took), 4).alias("most_seconds"), F.sum("saved").alias("saved"))
    )


@query(
    f"""WITH {_LATEST}, x AS (SELECT attempts, avg(finished_at - started_at) AS s FROM q WHERE finished_at IS NOT NULL AND started_at IS NOT NULL AND attempts IS NOT NULL GROUP BY attempts)
    SELECT attempts, round(s, 4) AS seconds, round((SELECT s FROM x ORDER BY attempts LIMIT 1) / s, 4) AS speed_up FROM x"""
)
def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    done = latest_states(spark, d).filter("finished_at IS NOT NULL AND started_at IS NOT NULL AND attempts IS NOT NULL")
    x = done.groupBy("attempts").agg(F.avg(F.col("finished_at") - F.col("started_at")).alias("s"))
    base = x.agg(F.min_by("s", "attempts").alias("base"))
    return x.select("attempts", F.round("s", 4).alias("seconds"), F.round(base.scalar() / F.col("s"), 4).alias("speed_up"))


@query(
    """SELECT job_id, updated_at FROM (SELECT job_id, max(updated_at) AS updated_at FROM jobs WHERE finished_at IS NOT NULL GROUP BY job_id) ORDER BY updated_at DESC NULLS LAST, job_id LIMIT 200"""
)
def history_200(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").filter("finished_at IS NOT NULL").groupBy("job_id").agg(F.max("updated_at").alias("updated_at"))
    return j.orderBy(F.desc_nulls_last("updated_at"), "job_id").limit(200)


def _error_case(column: str) -> str:
    out = "'unknown'"
    for code, _, tokens in reversed([r for r in scalars.ERROR_RULES if r[0] != "ffmpeg_missing"]):
        hit = " OR ".join(f"contains(lower({column}), '{t}')" for t in tokens)
        out = f"CASE WHEN {hit} THEN '{code}' ELSE {out} END"
    return out


@query(f"SELECT {_error_case('error')} AS code, count(*) AS n FROM item_states WHERE error IS NOT NULL GROUP BY 1")
def classify_errors(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "item_states").filter("error IS NOT NULL")
    return s.groupBy(scalars.error_code(F.col("error"))["code"].alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT item_id, observed_at, CAST(regexp_extract(message, '(\d+)\s*/\s*(\d+)\s*(?:mốc|frame)', 1) AS INT) AS done,
    greatest(1, CAST(regexp_extract(message, '(\d+)\s*/\s*(\d+)\s*(?:mốc|frame)', 2) AS INT)) AS total
    FROM (SELECT DISTINCT * FROM item_states) WHERE regexp_matches(message, '(\d+)\s*/\s*(\d+)\s*(?:mốc|frame)')"""
)
def progress_units(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "item_states").distinct()
    return s.select("item_id", "observed_at", scalars.progress_units(F.col("message")).alias("p")).filter("p IS NOT NULL").select("item_id", "observed_at", "p.done", "p.total")


@query(
    """SELECT o_orderkey, CAST(a AS INT) AS attempt, least(60.0, 1.5 * pow(2.0, a)) AS delay FROM orders, range(6) r(a)"""
)
def retry_ladder(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("attempt"))
    return o.withColumn("delay", scalars.retry_delay(F.col("attempt"), 1.5, 60.0))


@query(
    """SELECT p_partkey, CASE WHEN considered >= cur AND rejected * 4 >= considered AND rejected > 0 AND cur < mx THEN least(mx, cur + greatest(10, cur // 2)) ELSE cur END AS budget
    FROM (SELECT p_partkey, CAST(30 AS INT) AS cur, CAST(100 AS INT) AS mx, p_size AS considered, CAST(p_partkey % 20 AS INT) AS rejected FROM part)"""
)
def budget_expand(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", scalars.expand_budget(F.lit(30), F.lit(100), F.lit(10), F.col("p_size"), (F.col("p_partkey") % 20).cast("int")).alias("budget"))


# ---------------------------------------------------------------- text, sizes, addresses


@query(
    """WITH x AS (SELECT video_path, ts, CAST(round_even(ts * 1000, 0) AS BIGINT) AS ms FROM (SELECT DISTINCT video_path, ts FROM frame_candidates))
    SELECT video_path, ts, printf('%02d-%02d-%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS label FROM x"""
)
def timestamp_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frame_candidates").select("video_path", "ts").distinct().withColumn("label", scalars.timestamp_label(F.col("ts")))


@query(
    """WITH x AS (SELECT DISTINCT CAST(n_chars AS DOUBLE) * n_chars AS v FROM documents WHERE n_chars IS NOT NULL)
    SELECT v, CASE WHEN v < 1024 THEN printf('%.1f B', v) WHEN v < 1048576 THEN printf('%.1f KB', v / 1024) WHEN v < 1073741824 THEN printf('%.1f MB', v / 1048576)
      WHEN v < 1099511627776 THEN printf('%.1f GB', v / 1073741824) ELSE printf('%.1f TB', v / 1099511627776) END AS label,
    CASE WHEN v >= 3600 THEN printf('%dg %02dp', CAST(v AS BIGINT) // 3600, CAST(v AS BIGINT) // 60 % 60) WHEN v >= 60 THEN printf('%dp %02ds', CAST(v AS BIGINT) // 60, CAST(v AS BIGINT) % 60)
      ELSE printf('%ds', CAST(v AS BIGINT)) END AS eta FROM x"""
)
def size_labels(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("n_chars").cast("double") * F.col("n_chars")).alias("v")
    x = table(spark, d, "documents").filter("n_chars IS NOT NULL").select(v).distinct()
    return x.select("v", scalars.format_bytes(F.col("v")).alias("label"), scalars.format_eta(F.col("v")).alias("eta"))


_HOST = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\.', ''), '')"


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM (SELECT DISTINCT * FROM image_results) WHERE url IS NOT NULL AND url <> '' GROUP BY 1")
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "image_results").distinct().filter("url IS NOT NULL AND url <> ''")
    return r.groupBy(scalars.normalized_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT result_id, coalesce(regexp_matches(lower(url), '^https?://') AND ({_HOST} = 'pikselio.example' OR ends_with({_HOST}, '.pikselio.example')), false) AS supported FROM (SELECT DISTINCT * FROM image_results)"""
)
def url_supported(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "image_results").distinct().select("result_id", scalars.is_supported_url(F.col("url"), ("pikselio.example",)).alias("supported"))


@query("SELECT result_id, trim(regexp_replace(title, '<[^>]+>', '', 'g'), ' ') AS title FROM (SELECT DISTINCT * FROM image_results)")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "image_results").distinct().select("result_id", scalars.strip_html(F.col("title")).alias("title"))


@query("SELECT url, arg_min(source, result_id) AS source, min(result_id) AS result_id FROM image_results WHERE url IS NOT NULL GROUP BY url")
def first_wins_url(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "image_results").select("url", "source", "result_id")
    return relational.first_wins(r, "url", "result_id").select("url", "source", "result_id")


@query(
    """WITH r AS (SELECT DISTINCT * FROM image_results), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY result_id) AS n FROM r)
    SELECT source, result_id, CAST(n AS INT) AS place FROM k WHERE n <= 50"""
)
def source_topn(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "image_results").select("source", "result_id").distinct()
    w = Window.partitionBy("source").orderBy("result_id")
    return r.withColumn("place", F.row_number().over(w)).filter("place <= 50").select("source", "result_id", "place")


@query(
    r"""WITH r AS (SELECT DISTINCT result_id, url, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS suffix, coalesce(width, 0) AS w, regexp_replace(url, '/[^/]*$', '') AS stem FROM image_results WHERE url IS NOT NULL)
    SELECT stem, arg_max(result_id, (suffix = 'jpg', w, -result_id)) AS result_id FROM r GROUP BY stem"""
)
def variant_choice(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "image_results").filter("url IS NOT NULL").select(
        F.regexp_replace("url", "/[^/]*$", "").alias("stem"), "result_id", (F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)) == "jpg").alias("j"), F.coalesce("width", F.lit(0)).alias("w")
    ).distinct()
    return r.groupBy("stem").agg(F.max_by("result_id", F.struct("j", "w", -F.col("result_id"))).alias("result_id"))


@query(
    """SELECT result_id, width, height, CASE WHEN width * 9 > height * 16 THEN CAST(round_even(height * 16 / 9, 0) AS INT) ELSE width END AS crop_w,
    CASE WHEN width * 9 < height * 16 THEN CAST(round_even(width * 9 / 16, 0) AS INT) ELSE height END AS crop_h,
    CASE WHEN width > 640 THEN greatest(1, CAST(round_even(height * 640 / width, 0) AS INT)) ELSE height END AS new_height
    FROM (SELECT DISTINCT result_id, width, height FROM image_results WHERE width > 0 AND height > 0)"""
)
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "image_results").filter("width > 0 AND height > 0").select("result_id", "width", "height").distinct()
    box = scalars.crop_box(F.col("width"), F.col("height"), "16:9")
    return r.select("result_id", "width", "height", box["w"].alias("crop_w"), box["h"].alias("crop_h"), scalars.resized_height(F.col("width"), F.col("height"), 640).alias("new_height"))


_SUFFIX = r"lower(regexp_extract(video_path, '(\.[^./]+)$', 1))"


@query(f"SELECT {_SUFFIX} AS suffix, count(*) AS n, count(DISTINCT video_path) AS videos FROM queue_items WHERE video_path IS NOT NULL GROUP BY 1")
def listing_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queue_items").filter("video_path IS NOT NULL")
    return q.groupBy(F.lower(F.regexp_extract("video_path", r"(\.[^./]+)$", 1)).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video_path").alias("videos"))


@query("SELECT doc_kind, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY doc_kind")
def size_by_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"), F.max("n_chars").alias("longest"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 25")
def topk_largest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(25)


_DOCS = "e AS (SELECT doc_id, written_at, n_chars FROM documents WHERE n_chars IS NOT NULL AND written_at IS NOT NULL)"


@query(
    f"""WITH {_DOCS}, x AS (SELECT *, sum(n_chars) OVER (ORDER BY written_at, doc_id) - n_chars AS before, (SELECT sum(n_chars) FROM e) AS total FROM e)
    SELECT doc_id, n_chars, CAST(before AS BIGINT) AS freed_before FROM x WHERE total - before > 500000"""
)
def evict_quota(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").select("doc_id", "written_at", "n_chars").filter("n_chars IS NOT NULL AND written_at IS NOT NULL")
    return relational.evict(e, "written_at", "doc_id", "n_chars", 500_000).select("doc_id", "n_chars", "freed_before")


@query(
    f"""WITH {_DOCS}, g AS (SELECT * FROM e WHERE written_at < TIMESTAMP '2026-01-20'),
    x AS (SELECT *, sum(n_chars) OVER (ORDER BY written_at, doc_id) - n_chars AS before, (SELECT sum(n_chars) FROM g) AS total FROM g)
    SELECT doc_id, n_chars, CAST(before AS BIGINT) AS freed_before FROM x WHERE total - before > 100000"""
)
def evict_stale(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").select("doc_id", "written_at", "n_chars").filter("n_chars IS NOT NULL AND written_at IS NOT NULL")
    old = F.to_timestamp_ntz(F.lit("2026-01-20 00:00:00"))
    return relational.evict(e, "written_at", "doc_id", "n_chars", 100_000, old, count_all=False).select("doc_id", "n_chars", "freed_before")


PATTERNS = ("scene", "ERROR", "checkpoint", "khung", "queue item")


@query(
    f"""WITH l AS (SELECT doc_id, unnest(list_zip(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), range(1, len(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) + 1))) AS x FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(x[2] AS INT) AS line, p AS pattern FROM l, unnest({list(PATTERNS)}) t(p) WHERE contains(x[1], p)"""
)
def pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    return relational.scan_patterns(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text", PATTERNS)


@query(f"SELECT p AS label, (SELECT count(*) FROM documents WHERE contains(text, p)) AS n_texts FROM unnest({[*PATTERNS, 'no such label']}) t(p)")
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    return relational.label_coverage(table(spark, d, "documents"), "text", (*PATTERNS, "no such label"))


@query(
    r"""SELECT source, coalesce(list_sort(list_distinct(list(lang) FILTER (lang IS NOT NULL))), CAST([] AS VARCHAR[])) AS langs FROM documents WHERE source IS NOT NULL GROUP BY source"""
)
def distinct_settings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))


@query(
    """SELECT result_id, coalesce(nullif(trim(author, ' '), ''), nullif(trim(source, ' '), ''), 'unknown') AS credit,
    (coalesce(trim(author, ' '), '') <> '' OR coalesce(trim(license, ' '), '') <> '' OR coalesce(trim(page_url, ' '), '') <> '') AS has_meta FROM (SELECT DISTINCT * FROM image_results)"""
)
def credit_lines(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    some = clean("author").isNotNull() | clean("license").isNotNull() | clean("page_url").isNotNull()
    return table(spark, d, "image_results").distinct().select("result_id", F.coalesce(clean("author"), clean("source"), F.lit("unknown")).alias("credit"), some.alias("has_meta"))


@query(
    """SELECT DISTINCT url, coalesce(trim(regexp_replace(title, '<[^>]+>', '', 'g'), ' '), '') AS title, source, coalesce(width, 0) AS width, coalesce(height, 0) AS height FROM image_results WHERE url IS NOT NULL AND url <> ''"""
)
def normalize_hits(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as payloads of one search service, then read by its parser."""
    r = table(spark, d, "image_results").filter("url IS NOT NULL AND url <> ''")
    hit = F.struct(F.col("url").alias("image"), scalars.strip_html(F.col("title")).alias("title"), F.col("source").alias("thumbnail"), F.col("page_url").alias("url"), "width", "height")
    parsed = payloads.duckduckgo(r.select(F.to_json(F.struct(F.array(hit).alias("results"))).alias("payload")), "payload")
    return parsed.select("url", "title", F.col("thumbnail").alias("source"), "width", "height").distinct()


# ---------------------------------------------------------------- extensions


@query(
    """SELECT time_bucket(INTERVAL 1 hour, ts) AS "start", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return progress.tumbling(table(spark, d, "events"), "ts", "event_type", "value", "1 hour", "10 minutes")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hour THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS "start", count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return progress.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours", "10 minutes")


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def status_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))
