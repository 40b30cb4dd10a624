"""Links and connected groups from bucketed candidates, without all pairs of a bucket and without the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwell.llm.shared import hot_join, staged

SMALL = 8


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node it can reach.

    Each round a node takes the smallest label of its neighbours and then its label's label; labels only fall and
    are nodes of the same group, so the end is the smallest one. Rounds are written to the shared folder.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = staged(hooked.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = moved.select("node", "component")
        if moved.filter("component < old").isEmpty():
            return labels


def bucket_links(members: DataFrame, verify: Callable[[DataFrame], DataFrame], sketches: Callable[[DataFrame], DataFrame] | None = None,
                 alike: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) that connect all that candidates can connect, and the groups (node, component).

    ``members`` (bucket, node): nodes that share a bucket are candidates. ``verify`` keeps the pairs (a, b) that are
    truly linked. A node weighs as much as its buckets hold: the text that others were made from meets most of them.
    In each round some nodes of a bucket lead it, the heaviest first (one; then all in a bucket of at most SMALL nodes,
    and 4, 64, ... in larger ones), and are paired with its other nodes of other groups. A bucket is done when all its
    nodes are in one group or all but one have led. So two linked nodes of a bucket always end in one group, no bucket
    emits all its pairs unless nothing in it is linked, and no task ever holds a bucket. A pair is verified once,
    however many buckets it shares. Where ``sketches`` is given, it is called once, with the nodes that are left after
    the first round (node, crowded: whether the node is in a bucket of over SMALL nodes), and gives (node, sketch);
    later pairs go on only where ``alike`` holds for both sketches, and it must not refuse linked pairs.
    """
    spread = F.xxhash64("node")
    sizes = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    sized = staged(hot_join(members, sizes.select("bucket", "n"), ["bucket"], "n", members.count(), how="inner"))
    weights = sized.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = staged(sized.drop("n").join(weights, "node"))
    leads = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top"), F.count(F.lit(1)).alias("n"))
    open_ = staged(hot_join(weighed, leads.select("bucket", F.col("top.node").alias("lead"), "n"), ["bucket"], "n", weighed.count(), how="inner"))
    pairs = open_.filter("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    tried = staged(pairs)
    links = staged(verify(tried).select("a", "b"))
    groups = components(links)
    state = open_.select("bucket", "node", "weight", (F.col("node") == F.col("lead")).alias("led"))
    leaders, drawn = 4, None
    while True:
        named = staged(state.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
        mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"),
                                            F.count(F.when(~F.col("led"), 1)).alias("waiting")).filter("low < high AND waiting > 1")
        left = staged(hot_join(named, mixed.select("bucket", "n"), ["bucket"], "n", named.count(), how="inner"))
        if left.isEmpty():
            return links, groups
        # in a large bucket the heaviest waiting node of each of some parts leads next
        part = F.when(F.col("n") <= SMALL, spread).otherwise(F.pmod(F.xxhash64("node", F.lit(leaders)), F.lit(leaders)))
        next_ = left.filter(~F.col("led")).groupBy("bucket", part.alias("part")).agg(F.max(F.struct("weight", "node", "component", "n")).alias("lead"))
        next_ = staged(next_.select("bucket", "lead.n", F.col("lead.node").alias("lead"), F.col("lead.component").alias("lead_component")))
        # a node that has led met all of its bucket then
        waiting = left.filter(~F.col("led")).select("bucket", "node", "component", "n")
        near = F.col("component") != F.col("lead_component")
        heads = next_
        if sketches is not None:
            if drawn is None:
                drawn = staged(sketches(left.groupBy("node").agg(F.max(F.col("n") > SMALL).alias("crowded"))))
            waiting = waiting.join(drawn, "node")
            heads = heads.join(drawn.select(F.col("node").alias("lead"), F.col("sketch").alias("lead_sketch")), "lead")
            near &= alike(F.col("sketch"), F.col("lead_sketch"))
        follow = hot_leaders(waiting, heads, near)
        pairs = follow.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        found = staged(verify(pairs).select("a", "b"))
        if not found.isEmpty():
            links = staged(links.union(found).distinct())
            groups = components(links)
        chosen = next_.select("bucket", F.col("lead").alias("node"), F.lit(True).alias("chosen"))
        state = left.select("bucket", "node", "weight", "led").join(chosen, ["bucket", "node"], "left")
        state = state.select("bucket", "node", "weight", (F.col("led") | F.coalesce("chosen", F.lit(False))).alias("led"))
        leaders *= 16


def hot_leaders(left: DataFrame, leads: DataFrame, near: Column) -> DataFrame:
    """Members next to each leader of their bucket that ``near`` holds for; the members of a bucket are dealt over
    several tasks by its size."""
    salts = F.least(F.lit(256), F.ceil(F.col("n") / 512)).cast("int")
    dealt = left.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).drop("n")
    copies = leads.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n").withColumnsRenamed({"bucket": "lead_bucket", "salt": "lead_salt"})
    return dealt.join(copies, (F.col("bucket") == F.col("lead_bucket")) & (F.col("salt") == F.col("lead_salt")) & near)
