"""Replay, graph, store and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import replay
from loomline.sources import store
from loomline.streaming import packets as streams

from .data import table

#: Lines of an order as edits of a text and as moves of up to five objects.
EDITS = """
SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
  CASE l_returnflag WHEN 'A' THEN 'add' WHEN 'N' THEN 'replace' ELSE 'remove' END AS op,
  CASE l_returnflag WHEN 'A' THEN concat(' part', CAST(l_partkey % 10 AS STRING)) ELSE CAST(l_suppkey % 10 AS STRING) END AS a,
  CASE l_returnflag WHEN 'N' THEN concat('<', CAST(l_linenumber AS STRING), '>') END AS b,
  CAST(l_suppkey % 3 AS BIGINT) AS object_id, CAST(l_quantity AS BIGINT) AS dx, CAST(l_linenumber AS BIGINT) AS dy,
  CASE WHEN l_linestatus = 'F' THEN concat('c', CAST(l_partkey AS STRING)) END AS colour, CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS BIGINT) END AS radius, l_extendedprice AS e
FROM {lineitem}"""
_E = "WITH e AS (" + EDITS.replace("{lineitem}", "lineitem") + ")"
ORDER = ["n", "p", "s", "e"]


def edits(spark, sf_dir):
    return spark.sql(EDITS, lineitem=table(spark, sf_dir, "lineitem"))


def text_replay(spark, sf_dir):
    return replay.text_replay(edits(spark, sf_dir), ["doc"], ORDER, F.lit("order 5 of 7"))


_TEXT = f"""{_E}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n, p, s, e) AS k FROM e),
w AS (WITH RECURSIVE w AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS k, 'order 5 of 7' AS text FROM r
  UNION ALL SELECT w.doc, r.k, CASE WHEN op = 'add' THEN text || a WHEN op = 'replace' THEN replace(text, a, b) ELSE replace(text, a, '') END FROM w JOIN r ON r.doc = w.doc AND r.k = w.k + 1) SELECT * FROM w)
SELECT doc, arg_max(text, k) AS text FROM w GROUP BY doc"""


def _objects(rows):
    return rows.select("doc").distinct().withColumn("object_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long")))).withColumns({"x": F.col("object_id") * 100, "y": F.lit(50).cast("long"), "radius": F.lit(20).cast("long"), "colour": F.lit("blue")})


def scene_replay(spark, sf_dir):
    rows = edits(spark, sf_dir)
    return replay.scene_replay(_objects(rows), rows, ["doc"], ORDER)


def scene_drawings(spark, sf_dir):
    return replay.svg(scene_replay(spark, sf_dir), ["doc"])


_AT = "{'n': n, 'p': p, 's': s, 'e': e}"
_SCENE = f"""{_E.replace('l_extendedprice AS e', 'l_extendedprice AS ep')},
z AS (SELECT doc, object_id, sum(dx) AS mx, sum(dy) AS my, arg_max(colour, {{'n': n, 'p': p, 's': s, 'e': ep}}) FILTER (WHERE colour IS NOT NULL) AS c, arg_max(radius, {{'n': n, 'p': p, 's': s, 'e': ep}}) FILTER (WHERE radius IS NOT NULL) AS r FROM e GROUP BY ALL),
o AS (SELECT DISTINCT doc, unnest([0, 1]) AS object_id FROM e),
f AS (SELECT o.doc, CAST(o.object_id AS BIGINT) AS object_id, CAST(o.object_id * 100 + coalesce(mx, 0) AS BIGINT) AS x, CAST(50 + coalesce(my, 0) AS BIGINT) AS y, coalesce(r, 20) AS radius, coalesce(c, 'blue') AS colour FROM o LEFT JOIN z ON z.doc = o.doc AND z.object_id = o.object_id)"""


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").withColumn("object_id", F.col("n_nationkey").cast("long"))


def frames(spark, sf_dir):
    rows, k = _nations(spark, sf_dir), F.col("object_id")
    objects = rows.select("object_id", (k * 10).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(5).cast("long").alias("radius"), F.lit("blue").alias("colour"))
    motions = rows.select("object_id", (k % 7).alias("start_frame"), (k % 7 + 5).alias("end_frame"), (k % 3).alias("dx"), F.lit(1).cast("long").alias("dy"))
    first = rows.select("object_id", (k % 11).alias("frame"), F.lit(0).alias("ordinal"), F.lit("red").alias("colour"), F.lit(None).cast("long").alias("radius"))
    second = rows.select("object_id", (k % 5).alias("frame"), F.lit(1).alias("ordinal"), F.when(k % 2 == 0, "green").alias("colour"), (k % 4).alias("radius"))
    return replay.frame_replay(objects, motions, first.unionByName(second), 30)


_FRAMES = """SELECT CAST(f AS INT) AS frame, CAST(k AS BIGINT) AS object_id, CAST(k * 10 + CASE WHEN f >= k % 7 THEN (k % 3) * (least(f, k % 7 + 5) - k % 7) ELSE 0 END AS BIGINT) AS x,
  CAST(CASE WHEN f >= k % 7 THEN least(f, k % 7 + 5) - k % 7 ELSE 0 END AS BIGINT) AS y, CAST(CASE WHEN f >= k % 5 THEN k % 4 ELSE 5 END AS BIGINT) AS radius,
  CASE WHEN f >= k % 5 AND k % 2 = 0 THEN 'green' WHEN f >= k % 11 THEN 'red' ELSE 'blue' END AS colour FROM (SELECT n_nationkey AS k, unnest(range(30)) AS f FROM nation)"""


def branch_scenes(spark, sf_dir):
    rows = _nations(spark, sf_dir)
    origin = spark.createDataFrame([(0, 10, 10, 5, "blue"), (1, 20, 20, 5, "grey")], "object_id long, x long, y long, radius long, colour string")
    moves = rows.where("n_regionkey <> 2").select(F.col("n_regionkey").alias("branch"), (F.col("object_id") % 3).alias("object_id"), F.col("n_nationkey").alias("ordinal"), F.col("object_id").alias("dx"), F.lit(1).cast("long").alias("dy"), F.lit(None).cast("long").alias("radius"), F.col("n_name").alias("colour"))
    return replay.branch_replay(origin, moves, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("branch")), ["ordinal"])


_BRANCHES = """WITH o AS (SELECT r_regionkey AS branch, unnest([{'i': 0, 'x': 10, 'c': 'blue'}, {'i': 1, 'x': 20, 'c': 'grey'}]) AS s FROM region),
z AS (SELECT n_regionkey AS branch, n_nationkey % 3 AS i, sum(n_nationkey) AS dx, count(*) AS dy, arg_max(n_name, n_nationkey) AS c FROM nation WHERE n_regionkey <> 2 GROUP BY ALL)
SELECT o.branch, CAST(s.i AS BIGINT) AS object_id, CAST(s.x + coalesce(dx, 0) AS BIGINT) AS x, CAST(s.x + coalesce(dy, 0) AS BIGINT) AS y, CAST(5 AS BIGINT) AS radius, coalesce(z.c, s.c) AS colour FROM o LEFT JOIN z ON z.branch = o.branch AND z.i = s.i"""


def _links(spark, sf_dir):
    """An event's parent: the user's event before it, found bucket by bucket."""
    from loomline.operators.neighbours import with_previous

    rows = with_previous(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], ["event_id"], F.date_trunc("week", "ts"))
    return rows.where("previous IS NOT NULL").select(F.col("event_id").alias("state"), F.col("previous.event_id").alias("parent"))


def walk_origins(spark, sf_dir):
    return replay.origins(_links(spark, sf_dir))


def why_chain(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("state"))
    return replay.path_to(_links(spark, sf_dir), last)


_CHAIN = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def causes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("target"), (F.col("o_orderkey") % 97).alias("source"), F.col("o_orderpriority").alias("rule"), "o_orderstatus")
    return replay.parents(orders.where("o_orderstatus <> 'F'"), orders.where("o_orderstatus = 'F'"))


def next_states(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    branches = orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("condition"), (F.col("o_custkey") + 1).alias("target"), F.col("o_orderkey").alias("ordinal"))
    return replay.next_states(orders.select(F.col("o_custkey").alias("state"), F.col("o_orderstatus").alias("condition")).distinct(), branches)


def upserted_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("seq", F.lit(1))
    batch = orders.where("o_orderpriority = '1-URGENT'").withColumns({"o_orderstatus": F.lit("X"), "seq": F.lit(2)})
    return store.upserted(orders, batch, ["o_orderkey"], "seq").select("o_orderkey", "o_custkey", "o_orderstatus", "seq")


def latest_order(spark, sf_dir):
    return store.latest(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


def table_counts(spark, sf_dir):
    return store.row_counts({t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")})


def scoped_scan(spark, sf_dir):
    return store.scan(table(spark, sf_dir, "customer"), ["c_custkey"], c_mktsegment="BUILDING", c_nationkey=None).select("c_custkey", "c_name")


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def stream_packets(spark, sf_dir):
    rows = streams.event_stream(spark, sf_dir, SCHEMA, "events.parquet")
    return streams.drained(streams.running_packets(rows, "user_id", ["ts", "event_id"], "value", "event_type"), "packets", "complete")


def stream_usage(spark, sf_dir):
    rows = streams.event_stream(spark, sf_dir, SCHEMA, "events.parquet")
    out = streams.drained(streams.usage_windows(rows, "event_type", "value"), "usage", "complete")
    return out.select("window_start", "event_type", "n", F.round("total", 2).alias("total"))


QUERIES = {
    "J1_text_replay": (text_replay, _TEXT),
    "J2_scene_replay": (scene_replay, f"{_SCENE} SELECT * FROM f"),
    "J5_scene_drawings": (
        scene_drawings,
        f"""{_SCENE} SELECT doc, concat('<svg width="500" height="300">', string_agg(concat('<circle cx="', x, '" cy="', y, '" r="', radius, '" fill="', colour, '" />'), '' ORDER BY object_id), '</svg>') AS svg FROM f GROUP BY doc""",
    ),
    "J3_frames": (frames, _FRAMES),
    "J6_branches": (branch_scenes, _BRANCHES),
    "J9_causes": (
        causes,
        "SELECT o_custkey AS state, o_orderkey % 97 AS parent, o_orderpriority AS rule FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) = 1",
    ),
    "C14_walk_origins": (walk_origins, f"SELECT event_id AS state, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS origin, {_CHAIN} - 1 AS depth FROM events QUALIFY depth > 0"),
    "J10_why_chain": (
        why_chain,
        "SELECT first_value(event_id) OVER w AS target, row_number() OVER w - 1 AS depth, event_id AS state, parent FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events) "
        "WHERE parent IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)",
    ),
    "J12_next_states": (
        next_states,
        "WITH b AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW') SELECT DISTINCT o.o_custkey AS state, o.o_orderstatus AS condition, CASE WHEN b.o_custkey IS NULL THEN o.o_custkey ELSE o.o_custkey + 1 END AS next_state FROM orders o LEFT JOIN b USING (o_custkey, o_orderstatus)",
    ),
    "A10_upsert": (upserted_orders, "SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS seq FROM orders"),
    "A14_latest": (latest_order, "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1"),
    "A17_table_counts": (table_counts, " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))),
    "A11_scoped_scan": (scoped_scan, "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "A26_stream_packets": (
        stream_packets,
        "SELECT user_id, arg_max(value, {'t': ts, 'o': event_id}) AS latest_content, count(*) AS n_events, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_types FROM events GROUP BY user_id",
    ),
    "A26_stream_usage": (stream_usage, "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"),
}
