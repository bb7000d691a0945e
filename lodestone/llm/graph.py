"""Connected components of links between ids, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import storage
from lodestone.llm.storage import join_unique


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links (pairs of ids) -> id, root: every linked id and the smallest id reachable from it.

    Each id hooks to its smallest smaller neighbour, chains of hooks are halved until they are
    flat, and the links are contracted to their roots; ids and links at least halve each time, so
    the rounds grow with the logarithm of the ids. Minima are combined before they move, and joins
    leave rows of hot ids in place, hence an id with very many links is no burden to one task. Nulls and self-links are left out; repeated
    links count once; no links give no rows. All tables between rounds are settled.
    """
    edges = storage.settle(links.select(F.least(a, b).cast("long").alias("lo"), F.greatest(a, b).cast("long").alias("hi")).where("lo < hi").distinct())
    done: DataFrame | None = None
    while not edges.isEmpty():
        hooks = storage.settle(edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("root")))
        while True:
            over = hooks.select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = storage.settle(join_unique(hooks, over, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            storage.forget(hooks)
            hooks = jumped
            if not moved:
                break
        flat = hooks.select("id", "root")
        if done is None:
            now = storage.settle(flat)
        else:
            up = flat.select(F.col("id").alias("root"), F.col("root").alias("next"))
            now = storage.settle(join_unique(done, up, "root", "left").select("id", F.coalesce("next", "root").alias("root")).unionByName(flat.join(done.select("id"), "id", "left_anti")))
        lo, hi = flat.select(F.col("id").alias("lo"), F.col("root").alias("r1")), flat.select(F.col("id").alias("hi"), F.col("root").alias("r2"))
        halfway = storage.settle(join_unique(edges, hi, "hi"))
        moved_edges = join_unique(halfway, lo, "lo", "left").select(F.coalesce("r1", "lo").alias("x"), F.col("r2").alias("y"))
        rest = storage.settle(moved_edges.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).where("lo < hi").distinct())
        storage.forget(edges, halfway, hooks, done)
        edges, done = rest, now
    if done is None:
        return edges.select(F.col("lo").alias("id"), F.col("hi").alias("root"))
    storage.forget(edges)
    smallest = done.select(F.col("root").alias("id"), "root").distinct()
    out = storage.settle(done.unionByName(smallest.join(done.select("id"), "id", "left_anti")))
    storage.forget(done)
    return out
