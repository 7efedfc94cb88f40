"""Replay: texts from edits, scenes from moves, frames from rules, branches from one origin, and walks to the origin of a state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.sources.shared import written


def text_replay(edits: DataFrame, keys: list[str], order: list[str], origin: Column) -> DataFrame:
    """The text after all edits (op add, replace or remove; a, b) of each key, in order.

    A text's edits are folded where they are gathered; what is gathered is one text's own history. Empty needles change nothing.
    """
    steps = F.array_sort(F.collect_list(F.struct(*order, "op", "a", "b")))

    def step(text: Column, e: Column) -> Column:
        swap = F.replace(text, e["a"], F.when(e["op"] == "replace", F.coalesce(e["b"], F.lit(""))).otherwise(""))
        return F.when(e["op"] == "add", F.concat(text, F.coalesce(e["a"], F.lit("")))).when(e["op"].isin("replace", "remove") & (F.coalesce(e["a"], F.lit("")) != ""), swap).otherwise(text)

    return edits.groupBy(*keys).agg(steps.alias("_s"), F.first(origin).alias("_o")).select(*keys, F.aggregate("_s", F.col("_o"), step).alias("text"))


def scene_replay(objects: DataFrame, edits: DataFrame, scene: list[str], order: list[str]) -> DataFrame:
    """Objects (object_id, x, y, radius, colour) after all edits (dx, dy, radius, colour; null: unchanged) of their scene.

    Moves add up and the last colour and size win, so no order is needed but for those; edits of unknown objects are skipped.
    """
    at = F.struct(*order)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    sums = edits.groupBy(*scene, "object_id").agg(F.sum("dx").alias("_dx"), F.sum("dy").alias("_dy"), last("colour").alias("_colour"), last("radius").alias("_radius"))
    both = objects.join(sums, [*scene, "object_id"], "left")
    moved = lambda c: F.col(c) + F.coalesce(f"_d{c}", F.lit(0))
    return both.select(*scene, "object_id", moved("x").alias("x"), moved("y").alias("y"), F.coalesce("_radius", "radius").alias("radius"), F.coalesce("_colour", "colour").alias("colour"))


def frame_replay(objects: DataFrame, motions: DataFrame, changes: DataFrame, frames: int) -> DataFrame:
    """Every object in every frame.

    motions (object_id, start_frame, end_frame, dx, dy) act from their start, by min(frame, end) - start steps; of the
    changes (object_id, frame, ordinal, colour, radius) reached by a frame the last in list order wins, not the latest frame.
    """
    each = objects.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    steps = F.least("frame", "end_frame") - F.col("start_frame")
    shifts = (
        each.select("object_id", "frame").join(motions, "object_id").where("frame >= start_frame").groupBy("object_id", "frame").agg(F.sum(F.col("dx") * steps).alias("_dx"), F.sum(F.col("dy") * steps).alias("_dy"))
    )
    own = changes.withColumnRenamed("frame", "at_frame")
    last = lambda c: F.max_by(f"_n_{c}", F.when(F.col(f"_n_{c}").isNotNull(), F.col("ordinal"))).alias(f"_{c}")
    renamed = own.select("object_id", "at_frame", "ordinal", F.col("colour").alias("_n_colour"), F.col("radius").alias("_n_radius"))
    looks = each.select("object_id", "frame").join(renamed, "object_id").where("frame >= at_frame").groupBy("object_id", "frame").agg(last("colour"), last("radius"))
    both = each.join(shifts, ["object_id", "frame"], "left").join(looks, ["object_id", "frame"], "left")
    moved = lambda c: F.col(c) + F.coalesce(f"_d{c}", F.lit(0))
    return both.select("frame", "object_id", moved("x").alias("x"), moved("y").alias("y"), F.coalesce("_radius", "radius").alias("radius"), F.coalesce("_colour", "colour").alias("colour"))


def branch_replay(origin: DataFrame, edits: DataFrame, branches: DataFrame, order: list[str]) -> DataFrame:
    """The origin scene after the edits of each branch (column branch); a branch without edits shows the origin."""
    starts = branches.select("branch").distinct().join(F.broadcast(origin))  # one small scene
    return scene_replay(starts, edits, ["branch"], order)


def svg(objects: DataFrame, keys: list[str], width: int = 500, height: int = 300) -> DataFrame:
    """A drawing of each scene or frame; objects in id order."""
    circle = F.format_string('<circle cx="%s" cy="%s" r="%s" fill="%s" />', F.col("x").cast("string"), F.col("y").cast("string"), F.col("radius").cast("string"), F.col("colour"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("object_id", circle.alias("c")))), lambda o: o["c"])
    body = F.concat(F.lit(f'<svg width="{width}" height="{height}">'), F.array_join(ordered, ""), F.lit("</svg>"))
    return objects.groupBy(*keys).agg(body.alias("svg"))


def parents(transitions: DataFrame, branches: DataFrame) -> DataFrame:
    """(state, parent, rule): the one cause of each state; branches before transitions, first inserted first."""
    both = branches.select("source", "target", "rule", F.lit(0).alias("kind"), "ordinal").unionByName(transitions.select("source", "target", "rule", F.lit(1).alias("kind"), "ordinal"))
    first = both.groupBy("target").agg(F.min_by(F.struct("source", "rule"), F.struct("kind", "ordinal")).alias("_c"))
    return first.select(F.col("target").alias("state"), F.col("_c.source").alias("parent"), F.col("_c.rule").alias("rule"))


def origins(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(state, origin, depth) of every state with a parent, by doubling: each round jumps twice as far as the one before.

    links: state, parent. States on a cycle have no origin; they raise an error instead of running forever.
    """
    now = written(links.select("state", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth")), "walk")
    for _ in range(max_rounds):
        step = now.select(F.col("state").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        after = now.join(step, "at", "left")
        moved = written(after.select("state", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "walk")
        if not moved.where("moved").limit(1).count():
            return moved.select("state", F.col("at").alias("origin"), "depth")
        now = moved.select("state", "at", "depth")
    raise ValueError("the states form a cycle")


def path_to(links: DataFrame, targets: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(target, depth, state, parent) from each target (column state) back to its origin, depth 0 being the target itself.

    By doubling, too: a round adds, to every state already on a path, the one twice as far up as in the round before.
    """
    jumps = written(links.select("state", F.col("parent").alias("up"), F.lit(1).cast("long").alias("far")), "jumps")
    path = written(targets.select(F.col("state").alias("target"), "state", F.lit(0).cast("long").alias("depth")), "path")
    for _ in range(max_rounds):
        added = path.join(jumps, "state").select("target", F.col("up").alias("state"), (F.col("depth") + F.col("far")).alias("depth"))
        grown = written(path.unionByName(added), "path")
        if grown.count() == path.count():
            return path.join(links.select("state", "parent"), "state").select("target", "depth", "state", "parent")
        path = grown
        further = jumps.select(F.col("state").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        jumps = written(jumps.join(further, "up").select("state", F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far")), "jumps")
    raise ValueError("the states form a cycle")


def next_states(states: DataFrame, branches: DataFrame) -> DataFrame:
    """The state that each (state, condition) leads to; the same one if no branch fits."""
    steps = branches.groupBy(F.col("source").alias("state"), "condition").agg(F.min_by("target", "ordinal").alias("_to"))
    return states.join(steps, ["state", "condition"], "left").select("state", "condition", F.coalesce("_to", "state").alias("next_state"))
