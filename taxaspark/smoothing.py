"""Registered queries of running scales and smoothed curves over events."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from taxaspark.plans import smooth
from taxaspark.plans.evaluate import TABLED, t_quantile
from taxaspark.queries import query, std_sql, table

STD = std_sql("num", "m2")


@query(f"""WITH r AS (SELECT event_id, count(value) OVER o AS num, avg(value) OVER o AS mean, var_pop(value) OVER o * count(value) OVER o AS m2 FROM events WHERE value IS NOT NULL WINDOW o AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, {STD} / 0.5 AS s FROM r) SELECT event_id, num, round(mean + 1e-9, 6) AS mean, round(CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS scale FROM s""")
def running_scales(spark, sf_dir):
    """The scale of values before each event is placed, as events arrive; means are rounded off their ties."""
    av = table(spark, sf_dir, "events").select("event_id", F.lit("value").alias("attr"), F.col("value").alias("nval"))
    return smooth.running_scales(av, "event_id").select("event_id", "num", F.round(F.col("mean") + 1e-9, 6).alias("mean"), F.round("scale", 6).alias("scale"))


def _round_sql(k: int) -> str:
    """SQL for a round: the line ``l<k>`` from the weighted points ``p<k>``, and the points of the next one."""
    return f"""g{k} AS (SELECT x AS x2, sum(delta) AS s, sum(delta * y) AS sy FROM p{k} GROUP BY x),
m{k} AS (SELECT w.x, sum(w * s) AS a0, sum(w * s * x2) AS a1, sum(w * s * x2 * x2) AS a2, sum(w * sy) AS b0, sum(w * sy * x2) AS b1 FROM w JOIN g{k} USING (x2) GROUP BY w.x),
l{k} AS (SELECT x, b0 / a0 + (a0 * b1 - a1 * b0) / (a0 * a2 - a1 * a1) * (x - a1 / a0) AS smooth FROM m{k}),
r{k} AS (SELECT x, y, smooth, y - smooth AS r FROM p{k} JOIN l{k} USING (x)), s{k} AS (SELECT quantile_disc(abs(r), 0.5) AS s FROM r{k}),
p{k + 1} AS (SELECT x, y, pow(1 - pow(greatest(least(r / (6 * s), 1.0), -1.0), 2), 2) AS delta FROM r{k}, s{k})"""


Z = NormalDist().inv_cdf(0.975)
STUDENT = f"CASE WHEN n - 1 <= {TABLED} THEN [{', '.join(repr(t_quantile(0.975, k)) for k in range(1, TABLED + 1))}][n - 1] ELSE {Z} + {(Z**3 + Z) / 4} / (n - 1) + {(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96} / pow(n - 1, 2) + {(3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384} / pow(n - 1, 3) END"


@query(f"""WITH p0 AS (SELECT CAST(hour(ts) AS DOUBLE) AS x, value AS y, 1.0::DOUBLE AS delta FROM events WHERE value IS NOT NULL), c AS (SELECT x, count(*) AS n FROM p0 GROUP BY x),
d AS (SELECT a.x, b.x AS x2, abs(a.x - b.x) AS d, b.n FROM c a CROSS JOIN c b), u AS (SELECT x, d, sum(n) OVER (PARTITION BY x ORDER BY d) AS upto FROM d),
h AS (SELECT x, min(d) AS h FROM u WHERE upto >= (SELECT ceil(sum(n) / 3.0) + 1 FROM c) GROUP BY x), w AS (SELECT x, x2, pow(1 - pow(least(d / h, 1.0), 3), 3) AS w FROM d JOIN h USING (x)),
{_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)}, f AS (SELECT x, count(*) AS n, any_value(smooth) AS smooth, avg(r * r) AS r2 FROM r2 GROUP BY x)
SELECT x, n, round(smooth, 6) AS smooth, round(CASE WHEN n > 1 THEN sqrt(r2) / sqrt(n) * ({STUDENT}) END, 6) AS half_width FROM f""")
def lowess(spark, sf_dir):
    """Events' values smoothed over the hours of the day, with intervals."""
    e = table(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), "value")
    return smooth.lowess(e, "hour", "value").select("x", "n", F.round("smooth", 6).alias("smooth"), F.round("half_width", 6).alias("half_width"))
