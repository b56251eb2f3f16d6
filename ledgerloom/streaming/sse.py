"""Server-sent events of a run: fields of events, nodes, completed steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parsed(block: Column) -> Column:
    """struct(event, data) of one block: the last event line, data lines joined."""
    lines = F.split(block, r"\r?\n", -1)
    field = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(name)), lambda x: F.trim(F.substring(x, len(name) + 1, F.length(x))))
    return F.struct(F.coalesce(F.try_element_at(field("event:"), F.lit(-1)), F.lit("")).alias("event"), F.array_join(field("data:"), "").alias("data"))


def events(raw: DataFrame, by: str, text: str) -> DataFrame:
    """(by, pos, event, data): whole blocks, ended by a blank line; what follows the last one isn't whole."""
    blocks = F.split(F.col(text), r"\r?\n\r?\n", -1)
    rows = raw.select(by, F.posexplode(F.slice(blocks, F.lit(1), F.greatest(F.lit(0), F.size(blocks) - 1))).alias("pos", "block"))
    return rows.select(by, "pos", parsed(F.col("block")).alias("e")).select(by, "pos", "e.event", "e.data")


def nodes(events_: DataFrame, by: str, pos: str = "pos") -> DataFrame:
    """(by, pos, node) of message events whose data is a list with a node's name in its second item."""
    node = F.get_json_object("data", "$[1].langgraph_node")
    return events_.where("event = 'messages'").select(by, pos, F.nullif(node, F.lit("")).alias("node")).where("node is not null")


def steps(nodes_: DataFrame, by: str, pos: str = "pos") -> DataFrame:
    """(by, active, completed): the latest node, and those that another one followed, once each in order."""
    own = Window.partitionBy(by).orderBy(pos)
    left = nodes_.withColumn("next", F.lead("node").over(own)).where("next is not null and next <> node")
    done = left.groupBy(by, "node").agg(F.min(pos).alias("at")).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("completed"))
    active = nodes_.groupBy(by).agg(F.max_by("node", pos).alias("active"))
    return active.join(done, by, "left").withColumn("completed", F.coalesce("completed", F.array().cast("array<string>")))
