"""Groups of records linked directly or indirectly (connected components), over any number of pairs.

Deterministic Boruvka hooking. In each round every component selects its smallest outgoing edge, the trees
so formed collapse by pointer doubling, and the edges are relabelled and deduplicated; rounds go on until no
edge is left. The order of edges is that of a hash of their two ends (the ends break ties), so that trees stay
shallow whatever the shape of the graph. At least half of the components that still have an edge vanish
in each round: the number of rounds is at most the binary logarithm of the number of records.

Between rounds only bigint columns move. The label tables of the rounds shrink at least by half from one to
the next and are composed from the last to the first, so that all records are joined once, not once a round.
Every relabelling is a ``lookup_join``, which keeps a component with very many rows from gathering in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.skew import lookup_join
from tracewright.session import cut


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _hook(edges: DataFrame) -> DataFrame:
    """``node, parent`` for each component with an edge: across its smallest edge, roots pointing at themselves."""
    ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low, high = F.least("u", "v"), F.greatest("u", "v")
    rank = F.struct(F.xxhash64(low, high).alias("h"), low.alias("l"), high.alias("r"), F.col("v").alias("to"))
    chosen = cut(ends.groupBy(F.col("u").alias("node")).agg(F.min(rank)["to"].alias("parent")))
    back = chosen.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    # an edge chosen from both its ends would be a cycle of two: its smaller end becomes the root
    root = (F.col("grand") == F.col("node")) & (F.col("node") < F.col("parent"))
    return lookup_join(chosen, back, "parent", "inner").select("node", F.when(root, F.col("node")).otherwise(F.col("parent")).alias("parent"))


def _collapse(tree: DataFrame) -> DataFrame:
    """``node, label``: pointer doubling until every node points at its root."""
    tree = cut(tree)
    while True:
        up = tree.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        moved = cut(
            lookup_join(tree, up, "parent", "inner").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("went"))
        )
        tree = moved.select("node", "parent")
        if moved.where("went").isEmpty():
            return tree.withColumnRenamed("parent", "label")


def _relabel(edges: DataFrame, labels: DataFrame, end: str) -> DataFrame:
    other = "v" if end == "u" else "u"
    return lookup_join(edges, labels.withColumnRenamed("node", end), end, "inner").select(F.col("label").alias(end), other)


def components_of_ids(edges: DataFrame) -> DataFrame:
    """``node, root`` for each end of bigint ``edges(u, v)`` that has another end; ``root`` is the smallest id of its component."""
    edges = cut(_undirected(edges))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        labels = _collapse(_hook(edges))
        rounds.append(labels)
        edges = cut(_undirected(_relabel(_relabel(edges, labels, "u"), labels, "v")))
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = rounds.pop()
    while rounds:
        # a label of this round that meets no later one had no edge left
        later = found.select(F.col("node").alias("label"), F.col("label").alias("_to"))
        found = cut(lookup_join(rounds.pop(), later, "label", "left").select("node", F.coalesce("_to", "label").alias("label")))
    least = cut(found.groupBy("label").agg(F.min("node").alias("root")))
    return lookup_join(found, least, "label", "inner").select("node", "root")


def connected_groups(links: DataFrame, left: str, right: str, *, record: str = "record", group: str = "group") -> DataFrame:
    """One row per record with its group: the smallest record linked to it directly or indirectly.

    ``links`` has one row per link in columns ``left`` and ``right``, of one type that can be ordered; other
    columns are left aside. A record linked with nothing, with itself or with null only is its own group;
    null is no record; repeated links count once; no links give no rows. Output: ``record``, ``group``.
    """
    pairs = cut(links.select(F.col(left).alias("a"), F.col(right).alias("b")).distinct())
    records = pairs.select(F.col("a").alias("r")).unionByName(pairs.select(F.col("b").alias("r"))).where("r is not null").distinct()
    # ids in the order of the records: partitions hold ascending ranges, and the checkpoints fix them
    ordered = cut(records.repartitionByRange("r").sortWithinPartitions("r"))
    numbered = cut(ordered.select("r", F.monotonically_increasing_id().alias("id")))
    both = pairs.where("a is not null and b is not null and a <> b")
    for column, name in (("a", "u"), ("b", "v")):
        both = lookup_join(both, numbered.select(F.col("r").alias(column), F.col("id").alias(name)), column, "inner").drop(column)
    found = cut(components_of_ids(both))
    rooted = numbered.join(found, numbered["id"] == found["node"], "left").select("r", F.coalesce("root", "id").alias("root"))
    names = numbered.select(F.col("id").alias("root"), F.col("r").alias("name"))
    heads = names.join(found.select("root").distinct(), "root", "left_semi")
    grouped = lookup_join(rooted, heads, "root", "left")
    return grouped.select(F.col("r").alias(record), F.coalesce("name", "r").alias(group))
