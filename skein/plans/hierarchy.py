"""Problem 5: the reply graph of raw_messages as full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import numeric_id
from skein.operators import hierarchy as H
from skein.session import Scratch, read


def message_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "raw_messages").select(numeric_id(F.col("tweet_id")).alias("c"), numeric_id(F.col("in_response_to_tweet_id")).alias("p"))
    return H.unique_links(rows, "c", "p")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.roots(message_links(spark, sf_dir)).select(F.col("id").alias("tweet_id"), F.col("root").alias("root_tweet_id"), "depth")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message's path, depth and root; path is null in or before a loop."""
    return H.paths(message_links(spark, sf_dir)).select(
        F.col("id").alias("tweet_id"), F.col("root").alias("root_tweet_id"), "depth", F.when(F.col("path").isNotNull(), F.array_join(F.col("path").cast("array<string>"), ">")).alias("path")
    )


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with each of its descendants and the distance between them."""
    d = H.descendants(H.paths(message_links(spark, sf_dir)))
    return d.select(F.col("ancestor").alias("tweet_id"), F.col("descendant").alias("descendant_tweet_id"), F.col("distance").cast("int").alias("distance"))


def p5_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages caught in a loop, or leading into one."""
    scratch = Scratch(spark, "p5-loops")
    links = scratch.cut(message_links(spark, sf_dir), "links")
    return H.loop_members(H.roots(links, scratch), links, scratch).select(F.col("id").alias("tweet_id"), F.col("loop").alias("loop_tweet_id"), "in_loop")


QUERIES = {"p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants, "p5_loops": p5_loops}

_ID = "CASE WHEN regexp_matches(trim({0}), '^[+-]?[0-9]+(\\.[0-9]*)?$') AND try_cast(trim({0}) AS DECIMAL(38,6)) = try_cast(trunc(try_cast(trim({0}) AS DECIMAL(38,6))) AS BIGINT) THEN try_cast(trunc(try_cast(trim({0}) AS DECIMAL(38,6))) AS BIGINT) END"
_LINKS = f"""
raw AS (SELECT {_ID.format("tweet_id")} AS id, {_ID.format("in_response_to_tweet_id")} AS p FROM raw_messages),
said AS (SELECT id, min(p) AS p FROM raw WHERE id IS NOT NULL GROUP BY id),
links AS (SELECT s.id, k.id AS p FROM said s LEFT JOIN said k ON s.p = k.id),
up(id, a) AS (SELECT id, p FROM links WHERE p IS NOT NULL UNION SELECT u.id, l.p FROM up u JOIN links l ON u.a = l.id WHERE l.p IS NOT NULL),
top AS (SELECT id FROM links WHERE p IS NULL),
ring AS (SELECT id FROM up WHERE id = a),
good AS (SELECT id, id AS root, 0 AS depth FROM top
  UNION ALL SELECT u.id, max(CASE WHEN t.id IS NOT NULL THEN u.a END), count(*) FROM up u LEFT JOIN top t ON t.id = u.a GROUP BY u.id HAVING count(t.id) > 0),
bad AS (SELECT u.id, min(u.a) AS root FROM up u JOIN ring r ON r.id = u.a GROUP BY u.id)
"""
ORACLE = {
    "p5_found": f"WITH RECURSIVE {_LINKS} SELECT id AS tweet_id, root AS root_tweet_id, CAST(depth AS INTEGER) AS depth FROM good UNION ALL SELECT id, root, CAST(-1 AS INTEGER) FROM bad",
    "p5_paths": f"""WITH RECURSIVE {_LINKS},
      d AS (SELECT id, depth FROM good),
      chain AS (SELECT u.id, u.a, d.depth FROM up u JOIN d ON d.id = u.a UNION ALL SELECT id, id, depth FROM d),
      p AS (SELECT id, string_agg(CAST(a AS VARCHAR), '>' ORDER BY depth) AS path FROM chain WHERE id IN (SELECT id FROM d) GROUP BY id)
      SELECT g.id AS tweet_id, g.root AS root_tweet_id, CAST(g.depth AS INTEGER) AS depth, p.path FROM good g JOIN p ON p.id = g.id
      UNION ALL SELECT id, root, CAST(-1 AS INTEGER), CAST(NULL AS VARCHAR) FROM bad""",
    "p5_descendants": f"""WITH RECURSIVE {_LINKS} SELECT u.a AS tweet_id, u.id AS descendant_tweet_id, CAST(g.depth - k.depth AS INTEGER) AS distance
      FROM up u JOIN good g ON g.id = u.id JOIN good k ON k.id = u.a""",
    "p5_loops": f"WITH RECURSIVE {_LINKS} SELECT b.id AS tweet_id, b.root AS loop_tweet_id, r.id IS NOT NULL AS in_loop FROM bad b LEFT JOIN ring r ON r.id = b.id",
}
