"""Driver tables in the shapes of the engine: the same arithmetic as SQL text that Spark and other engines read alike."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartloom.operators import degrade
from heartloom.schemas import ROIS

#: Candidates from orders: subjects from customers, windows from orders, outcomes by modular arithmetic of keys, and
#: quality features from the order's lines, missing where there are none.
CANDIDATES = """
SELECT 'subject' || CAST(o.o_custkey % 42 + 1 AS STRING) AS subject, c.condition AS condition, o.o_orderkey AS window_id, r.roi AS roi, m.method AS method,
  CAST(60 + o.o_orderkey % 40 AS DOUBLE) AS reference_hr_bpm, o.o_orderkey % 11 <> 0 AS reference_valid, o.k AS order_key,
  CASE WHEN (o.o_orderkey * 31 + c.ci * 7 + r.ri * 3 + m.mi * 5) % 97 < 3 THEN 'low_video_coverage' WHEN (o.o_orderkey * 31 + c.ci * 7 + r.ri * 3 + m.mi * 5) % 97 < 5 THEN 'low_valid_fraction'
    WHEN (o.o_orderkey * 31 + c.ci * 7 + r.ri * 3 + m.mi * 5) % 97 < 7 THEN 'long_missing_gap' ELSE 'ok' END AS window_status,
  CASE WHEN (o.o_orderkey * 31 + c.ci * 7 + r.ri * 3 + m.mi * 5) % 97 >= 7
    THEN CAST((o.o_orderkey * 13 + c.ci * 17 + r.ri * 19 + m.mi * 23) % 41 - 20 AS DOUBLE) * (c.ci + 1) / 8e0 END AS signed_error_bpm
FROM (SELECT o_orderkey, o_custkey, o_orderkey AS k FROM orders) o
CROSS JOIN (VALUES ('original', 0), ('fps15', 1), ('fps10', 2), ('roi_shift_3', 3), ('roi_shift_5', 4)) AS c(condition, ci)
CROSS JOIN (VALUES ('full_face_inner', 0), ('forehead', 1), ('cheeks_mean', 2)) AS r(roi, ri)
CROSS JOIN (VALUES ('POS', 0), ('CHROM', 1)) AS m(method, mi)
"""
FEATURES = """
SELECT c.subject, c.condition, c.window_id, c.roi, c.method, c.reference_hr_bpm, c.reference_valid, c.window_status,
  c.reference_hr_bpm + c.signed_error_bpm AS rppg_hr_bpm, c.signed_error_bpm, abs(c.signed_error_bpm) AS absolute_error_bpm,
  l.n_lines / 8e0 AS valid_frame_fraction, l.max_disc AS max_missing_gap_sec, l.avg_qty AS mean_brightness, l.std_qty AS brightness_std, l.avg_tax AS mean_overexposure_ratio,
  CASE WHEN c.window_status = 'ok' THEN l.share END AS spectral_peak_fraction, CASE WHEN c.window_status = 'ok' THEN l.avg_disc * 10e0 END AS spectral_entropy,
  CASE WHEN c.window_status = 'ok' THEN CAST(c.window_id % 7 AS DOUBLE) END AS pos_chrom_diff_bpm
FROM ({candidates}) c
LEFT JOIN (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, max(l_discount) AS max_disc, avg(l_quantity) AS avg_qty, stddev_pop(l_quantity) AS std_qty, avg(l_tax) AS avg_tax,
    max(l_extendedprice) / sum(l_extendedprice) AS share, avg(l_discount) AS avg_disc
  FROM lineitem GROUP BY l_orderkey
) l ON l.l_orderkey = c.order_key
""".replace("{candidates}", CANDIDATES)

#: Traces from events: a user is a subject, a day a second, an event a frame; the signal is the value.
TRACE = """
SELECT 'subject' || CAST(user_id AS STRING) AS subject, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx,
  CAST({micros} - min({micros}) OVER (PARTITION BY user_id) AS DOUBLE) / 86400e6 AS time_sec, value, event_type <> 'error' AS good
FROM events
"""
#: Recordings from events: every 900 events, by number, are 30 s of a subject at 30 frames a second, with a pulse of their
#: own; the event's value adds a little noise.
RECORDING = """
SELECT 'subject' || CAST(e.rec + 1 AS STRING) AS subject, e.i AS frame_idx, CAST(e.i AS DOUBLE) / 30e0 AS time_sec, e.bpm AS bpm, e.noise AS noise
FROM (SELECT CAST(floor(event_id / 900e0) AS BIGINT) AS rec, event_id % 900 AS i, CAST(60 + 4 * (CAST(floor(event_id / 900e0) AS BIGINT) % 15) AS DOUBLE) AS bpm, (value - floor(value)) / 1e4 AS noise FROM events) e
"""
#: The same with rates that are no whole numbers of beats, and ten times the noise.
OFF_GRID = RECORDING.replace("CAST(60 + 4 * (CAST(floor(event_id / 900e0) AS BIGINT) % 15) AS DOUBLE)", "61.3e0 + 3.7e0 * (CAST(floor(event_id / 900e0) AS BIGINT) % 13)").replace("/ 1e4 AS noise", "/ 1e3 AS noise")
SPARK_MICROS, DUCK_MICROS = "unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"


def _views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _sql(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    for name, df in tables.items():
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **tables)


#: Orders of one partition of the candidates, each of which makes 30 of them.
ORDERS = 60_000


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of FEATURES. Orders meet the sums of their lines before each is made into its 30 candidates, so the shuffles
    hold orders and lines alone; the candidates of a window lie in one partition, whose size is bounded.
    """
    views = _views(spark, sf_dir, "orders", "lineitem")
    parts = max(spark.sparkContext.defaultParallelism, -(-views["orders"].count() // ORDERS))
    own, features = CANDIDATES.split("FROM (", 1)[0], FEATURES.split("LEFT JOIN (", 1)[1].split("  FROM lineitem", 1)[0]
    sums = _sql(spark, f"{features} FROM lines GROUP BY l_orderkey", {"lines": views["lineitem"].repartition(parts, "l_orderkey")})
    names = [c for c in sums.columns if c != "l_orderkey"]
    orders = views["orders"].select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey")
    both = orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    text = own + ", " + ", ".join(f"o.{n} AS {n}" for n in names) + " FROM (SELECT *, o_orderkey AS k FROM both) o" + CANDIDATES.split(") o", 1)[1]
    held = _sql(spark, text, {"both": both})
    shown = FEATURES.split("SELECT ", 1)[1].split("FROM (", 1)[0].replace("l.", "c.")
    return _sql(spark, f"SELECT {shown} FROM held c", {"held": held})


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without the quality features, which need the orders alone."""
    return _sql(spark, CANDIDATES, _views(spark, sf_dir, "orders")).withColumn("rppg_hr_bpm", F.col("reference_hr_bpm") + F.col("signed_error_bpm"))


def recordings(spark: SparkSession, sf_dir: str, text: str = RECORDING) -> DataFrame:
    return _sql(spark, text, _views(spark, sf_dir, "events"))


def contact_samples(spark: SparkSession, sf_dir: str, text: str = RECORDING) -> DataFrame:
    """Contact samples of the recordings; the sensor's values wrap round above 127."""
    held = recordings(spark, sf_dir, text)
    ppg = F.sin(2 * math.pi / 60 * F.col("bpm") * F.col("time_sec")) + F.col("noise")
    return held.select("subject", F.col("frame_idx").alias("i"), "time_sec", ppg.alias("ppg"), F.col("bpm").alias("sensor_hr"))


def colour_traces(spark: SparkSession, sf_dir: str, shift: float = 0.0, text: str = RECORDING) -> DataFrame:
    """Long traces of the recordings' three regions; the region drifts by that share of the face's width."""
    p, m = F.sin(2 * math.pi / 60 * F.col("bpm") * F.col("time_sec")), F.sin(2 * math.pi * 0.15 * F.col("time_sec")) * 0.004
    x, y = degrade.drift(F.col("time_sec"), F.lit(200.0), shift)
    rows = recordings(spark, sf_dir, text).withColumn("roi", F.explode(F.array(*map(F.lit, ROIS))))
    return rows.withColumns({
        "landmark_valid": F.lit(True), "face_width_px": F.lit(200.0), "face_area_ratio": F.lit(0.1), "face_center_shift": F.lit(0.001), "face_area_change": F.lit(0.002), "roi_shift_fraction": F.lit(shift),
        "roi_shift_x_px": x, "roi_shift_y_px": y, **{c: k * (1 + a * p + m + F.col("noise")) for c, k, a in (("r", 180.0, 0.003), ("g", 140.0, 0.010), ("b", 120.0, 0.005))}, "n_pixels": F.lit(1000).cast("long"),
        "brightness": F.lit(140.0), "overexposure_ratio": F.lit(0.0), "valid": F.lit(True), "retention_ratio": F.lit(1.0 - shift), "sel_seq": F.col("frame_idx"),
    }).drop("bpm", "noise")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, TRACE.replace("{micros}", SPARK_MICROS), _views(spark, sf_dir, "events"))


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """A query over driver tables."""
    return _sql(spark, text, _views(spark, sf_dir, *names))


def rasters(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(subject, frame_idx, width, height, raster, present) of frames given as rows of pixels (subject, frame_idx, x, y, r, g, b).

    Pixels without a row are not present. A frame's pixels meet in one row, and the raster is made of doubles.
    """
    each = pixels.groupBy("subject", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p"))
    each = each.select("subject", "frame_idx", *(F.col(f"p.{c}").cast("array<double>").alias(c) for c in ("x", "y", "r", "g", "b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, there = [], []
            for row in zip(*(batch.column(c) for c in ("x", "y", "r", "g", "b")), strict=True):
                x, y, *rgb = (v.values.to_numpy() for v in row)
                x, y = x.astype(int), y.astype(int)
                full = np.zeros((height, width, 3))
                full[y, x] = np.stack(rgb, 1)
                out.append(full.tobytes())
                there.append(np.stack((y, x, x + 1), 1).ravel())
            n = batch.num_rows
            cols = [batch.column("subject"), batch.column("frame_idx"), pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array(out, pa.binary()), pa.array(there, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["subject", "frame_idx", "width", "height", "raster", "present"])

    return each.mapInArrow(run, "subject string, frame_idx long, width int, height int, raster binary, present array<int>")
