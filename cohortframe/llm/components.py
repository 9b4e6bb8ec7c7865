"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in the links ``a, b``; component is the smallest id reachable.

    Each round gives every node the smallest label among itself and its neighbours, follows labels to
    their own labels, and contracts the links to labels, so a star is done in one round and a chain in
    about log2 of its length. Rounds end in stored tables; the driver sees a count for each. Minima are
    combined before they are shuffled; joins leave an unbounded centre to skew splitting.
    """
    todo = stored(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links"
    )
    done = None
    while not todo.isEmpty():
        both = todo.select("a", "b").union(todo.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("up")), "labels")
        # Labels point downwards; following them twice shortens paths fourfold.
        for _ in range(2):
            higher = label.select(F.col("id").alias("up"), F.col("up").alias("top"))
            label = label.join(higher, "up", "left").select("id", F.coalesce("top", "up").alias("up"))
        label = stored(label, "labels")
        if done is None:
            done = label.select("id", F.col("up").alias("component"))
        else:
            step = label.select(F.col("id").alias("component"), "up")
            done = done.join(step, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        done = stored(done, "components")
        left = label.select(F.col("id").alias("a"), F.col("up").alias("x"))
        right = label.select(F.col("id").alias("b"), F.col("up").alias("y"))
        todo = stored(
            todo.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
    if done is None:
        return todo.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return done
