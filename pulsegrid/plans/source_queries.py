"""The chart reader on text that Spark derives from the events: each user becomes one exported recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import columns as X
from pulsegrid.operators import effects as E, ordered as O
from pulsegrid.plans.registry import query
from pulsegrid.sources import labchart

PLACED = """p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""


def chart_lines(t):
    """Header lines, then ``time date value k [#* text]`` rows in blocks of 40 lines; errors are written as text."""
    e = t.events.select("user_id", "event_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"), X.micros("ts").alias("us"))
    p = O.positions(e, ["user_id"], "us", ["event_id"], "_p", block=F.floor(F.col("us") / O.block_width(e, ["user_id"], "us")))
    i = F.col("_p") - 1
    cell = F.when(F.col("event_type") == "error", F.lit("bad")).otherwise(F.col("k"))
    mark = F.when((F.col("event_type") == "purchase") & (i > 0), F.lit("#* purchase done"))
    row = F.concat_ws("\t", i.cast("string"), F.lit("14/12/2024"), F.col("value").cast("string"), cell, mark)
    name = F.col("user_id").cast("string")
    data = p.select(name.alias("recording_id"), F.floor(i / 40).cast("bigint").alias("block"), i.cast("bigint").alias("line_id"), row.alias("value"))
    head = t.events.select("user_id").distinct().select(name.alias("recording_id"), F.lit(0).cast("bigint").alias("block"), F.inline(F.array(
        *[F.struct(F.lit(n).cast("bigint").alias("line_id"), F.lit(v).alias("value")) for n, v in (
            (-3, "Interval=\t0.002 s"), (-2, "ChannelTitle=\tECG raw\tChannel 3"), (-1, "Range=\t10 V\t10 V"))])))
    return data.unionByName(head).withColumn("file", F.concat("recording_id", F.lit(".txt")))


@query("chart_layout", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS recording_id, CAST(3 AS BIGINT) AS n_header, 2 AS lead_cols, 3 AS ecg_col, 500 AS fs FROM events""")
def chart_layout(t):
    return labchart.layout(chart_lines(t)).select("recording_id", "n_header", "lead_cols", "ecg_col", "fs")


@query("chart_samples", f"""WITH {PLACED} SELECT CAST(user_id AS VARCHAR) AS recording_id, i AS sample_idx, CASE WHEN event_type <> 'error' THEN k END AS mv,
 CASE WHEN event_type = 'purchase' AND i > 0 THEN '*' END AS prefix, CASE WHEN event_type = 'purchase' AND i > 0 THEN '#* purchase done' END AS text FROM p""")
def chart_samples(t):
    lines = chart_lines(t)
    return labchart.parse(lines, labchart.layout(lines))


@query("chart_fixed_layout", f"""WITH {PLACED} SELECT CAST(user_id AS VARCHAR) AS recording_id, count(*) AS n, count(value) AS n_valid, round(sum(value), 4) AS total FROM p GROUP BY 1""")
def chart_fixed_layout(t):
    lines = chart_lines(t)
    parsed = labchart.parse(lines, labchart.fixed_layout(lines, 3, 2), "null")
    return parsed.groupBy("recording_id").agg(F.count("*").alias("n"), F.count("mv").alias("n_valid"), F.round(F.sum("mv"), 4).alias("total"))


@query("huber_slope")
def huber_slope(t):
    x = t.supplier.select((F.col("s_nationkey") % 2).alias("study"), (F.col("s_suppkey") % 4).alias("rank"), F.col("s_acctbal").alias("value"))
    return E.huber_slope(x, ["study"], "rank")
