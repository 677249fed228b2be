"""Conversation memory over the conversations table, and as-of joins over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import conversations as C
from ..operators import expand as X
from .registry import query, read

_T = "c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations)"


def turns(spark, sf):
    return read(spark, sf, "conversations").distinct()


@query(f"WITH {_T} SELECT conv_id, turn, age FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM c) WHERE age <= 3")
def turn_latest_n(spark, sf):
    return C.latest(turns(spark, sf), 3).select("conv_id", "turn", F.col("age").cast("long").alias("age"))


@query(f"WITH {_T} SELECT conv_id, turn, age FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM c WHERE role IN ('user', 'assistant')) WHERE age <= 3")
def turn_latest_n_spoken(spark, sf):
    return C.latest(turns(spark, sf), 3, ["user", "assistant"]).select("conv_id", "turn", F.col("age").cast("long").alias("age"))


_PAIRS = f"{_T}, p AS (SELECT conv_id, lag(turn) OVER w AS user_turn, turn AS assistant_turn, role, lag(role) OVER w AS was FROM c WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"WITH {_PAIRS} SELECT conv_id, user_turn, assistant_turn FROM p WHERE role = 'assistant' AND was = 'user'")
def turn_pairs(spark, sf):
    return C.pairs(turns(spark, sf))


@query(f"WITH {_PAIRS} SELECT conv_id, assistant_turn, CASE row_number() OVER (PARTITION BY conv_id ORDER BY assistant_turn DESC) WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END AS sentences FROM p WHERE role = 'assistant' AND was = 'user'")
def turn_tiers(spark, sf):
    return C.tiers(C.pairs(turns(spark, sf))).select("conv_id", "assistant_turn", "sentences")


@query("SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE role = 'system') AS n_system, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def turn_stats(spark, sf):
    return C.stats(read(spark, sf, "conversations"))


@query(f"WITH {_T} SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM c) WHERE age > 2")
def turn_recall(spark, sf):
    """Turns that recall may draw on: all but the newest two."""
    return C.without_recent(turns(spark, sf), 2).select("conv_id", "turn")


@query(f"WITH {_T}, t AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM c GROUP BY conv_id) SELECT conv_id, t[len(t) - 2] AS covers FROM t WHERE len(t) > 3")
def summary_due(spark, sf):
    return C.needs_summary(turns(spark, sf), keep=2, slack=1)


@query("""
WITH t AS (SELECT DISTINCT conv_id, turn, greatest(1, CAST(round(length(text) / 2.5) AS INTEGER)) AS cost FROM conversations WHERE length(text) > 0)
SELECT conv_id, turn, CAST(spent AS BIGINT) AS spent FROM (SELECT conv_id, turn, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent FROM t) WHERE spent <= 200""")
def budget_prefix(spark, sf):
    t = turns(spark, sf).where("length(text) > 0").select("conv_id", "turn", token_estimate(F.col("text")).alias("cost")).distinct()
    return X.budget_stop(t, "conv_id", ["turn"], "cost", 200).select("conv_id", "turn", "spent")


_SKIP = """
WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn, greatest(1, CAST(round(length(text) / 2.5) AS INTEGER)) AS cost FROM conversations WHERE length(text) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn {order}) AS i FROM t),
w AS (SELECT conv_id, turn, cost, i, cost <= 200 {first} AS took, CASE WHEN cost <= 200 {first} THEN cost ELSE 0 END AS spent FROM n WHERE i = 1
UNION ALL SELECT n.conv_id, n.turn, n.cost, n.i, w.spent + n.cost <= 200, w.spent + CASE WHEN w.spent + n.cost <= 200 THEN n.cost ELSE 0 END FROM w JOIN n ON n.conv_id = w.conv_id AND n.i = w.i + 1)
SELECT conv_id, turn FROM w WHERE took"""


def _costs(spark, sf):
    return turns(spark, sf).where("length(text) > 0").select("conv_id", "turn", token_estimate(F.col("text")).alias("cost")).distinct()


@query(_SKIP.format(order="", first=""))
def budget_skip(spark, sf):
    return X.budget_skip(_costs(spark, sf), "conv_id", "turn", "cost", 200).select("conv_id", "turn")


@query(_SKIP.format(order="DESC", first=""))
def budget_skip_newest(spark, sf):
    return X.budget_skip(_costs(spark, sf), "conv_id", "turn", "cost", 200, newest_first=True).select("conv_id", "turn")


@query(_SKIP.format(order="", first="OR true"))
def budget_keep_first(spark, sf):
    return X.budget_skip(_costs(spark, sf), "conv_id", "turn", "cost", 200, keep_first=True).select("conv_id", "turn")


@query("""
WITH a AS (SELECT user_id, ts FROM events WHERE event_type = 'signup')
SELECT e.event_id, max(a.ts) AS anchor FROM events e LEFT JOIN a ON a.user_id = e.user_id AND a.ts <= e.ts WHERE e.event_type <> 'signup' GROUP BY e.event_id""")
def asof_anchor(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return C.as_of(e.where("event_type <> 'signup'"), e.where("event_type = 'signup'"), "user_id", "ts").select("event_id", "anchor")


@query(f"""
WITH {_T}, s AS (SELECT DISTINCT conv_id, turn, conv_id * 7 + i * turn AS off, round(0.01 * (i + 1), 6) AS relevance FROM c, (SELECT unnest(range(5)) AS i) WHERE role = 'assistant'),
o AS (SELECT conv_id, turn, off, max(relevance) AS relevance FROM s WHERE relevance >= 0.02 GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY relevance DESC, off) AS r FROM o)
SELECT conv_id, turn, off AS "offset", relevance FROM r WHERE r <= 3""")
def cited_passages(spark, sf):
    """Sources written as JSON on each assistant turn, read back and ranked."""
    t = turns(spark, sf).withColumn("chunks", F.to_json(F.array(*[F.struct((F.col("conv_id") * 7 + i * F.col("turn")).alias("offset"), (F.lit(0.01) * (i + 1)).alias("relevance")) for i in range(5)])))
    return C.cited(t).withColumn("relevance", F.round("relevance", 6))


@query(f"""
WITH {_T} SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg(CASE role WHEN 'user' THEN '**You:** ' WHEN 'assistant' THEN '**Answer:** ' ELSE '**Note:** ' END || trim(text), chr(10) || chr(10) ORDER BY turn, role) || chr(10) AS markdown FROM c GROUP BY conv_id""")
def annotation_export(spark, sf):
    from ..sources.sinks import conversation_markdown

    return conversation_markdown(turns(spark, sf))


@query("SELECT conv_id, assistant_turn, 'Q: ' || left(u.text, 120) || ' A: ' || left(a.text, 200) AS summary FROM (WITH " + _PAIRS + " SELECT conv_id, user_turn, assistant_turn FROM p WHERE role = 'assistant' AND was = 'user') JOIN (SELECT DISTINCT conv_id, turn AS user_turn, text FROM conversations WHERE role = 'user') u USING (conv_id, user_turn) JOIN (SELECT DISTINCT conv_id, turn AS assistant_turn, text FROM conversations WHERE role = 'assistant') a USING (conv_id, assistant_turn)")
def pair_summary(spark, sf):
    t = turns(spark, sf)
    u = t.where("role = 'user'").select("conv_id", F.col("turn").alias("user_turn"), F.col("text").alias("q"))
    a = t.where("role = 'assistant'").select("conv_id", F.col("turn").alias("assistant_turn"), F.col("text").alias("a"))
    p = C.pairs(t).join(u, ["conv_id", "user_turn"]).join(a, ["conv_id", "assistant_turn"])
    return p.select("conv_id", "assistant_turn", C.fallback_summary(F.col("q"), F.col("a")).alias("summary"))


@query(f"WITH {_T} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM c WHERE role = 'system'")
def anchor_rows(spark, sf):
    """A conversation's turns of one role, the newest first."""
    return C.latest(turns(spark, sf), 1 << 30, ["system"]).select("conv_id", "turn", F.col("age").cast("long").alias("age"))
