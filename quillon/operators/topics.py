"""Groups of units that share tags, directly or through others: components of the graph that ties the units of a tag to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.graph import components as connected
from quillon.operators.lineage import written

#: Tags up to which the table of them is broadcast, so that no task gathers the units of a frequent one.
BROADCAST_TAGS = 1_000_000


def components(units: DataFrame, key: str = "unit_id") -> DataFrame:
    """``(key, topic)``: the smallest key that shared lower-cased tags reach; untagged units stand alone.

    A tag ties each of its units to the least of them: one edge per unit and tag, never a pair of units.
    """
    units = written(units.select(key, "tags"), "units")
    tagged = written(units.select(key, F.explode(F.array_distinct(F.transform("tags", F.lower))).alias("tag")), "tags")
    low = written(tagged.groupBy("tag").agg(F.min(key).alias("b")), "hubs")
    hubs = F.broadcast(low) if low.count() <= BROADCAST_TAGS else low
    found = connected(tagged.join(hubs, "tag").select(F.col(key).alias("a"), "b"))
    return units.select(key).join(found, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("topic"))
