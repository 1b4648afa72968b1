"""Event windows and sessions, in their batch form (tests run the streams against them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.plans.registry import Registry
from skein.session import read
from skein.streaming import stream as S

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), m AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 43200000000 THEN 0 ELSE 1 END AS new FROM e),
  g AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(us) AS start_us, max(us) + 43200000000 AS end_us, count(*) AS n_events FROM g GROUP BY user_id, s""")
def event_sessions(spark, sf):
    return S.sessions(read(spark, sf, "events"), "ts", "user_id")


@query("SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return S.windowed_counts(read(spark, sf, "events"), "ts", "event_type").withColumn("total", F.round("total", 6))
