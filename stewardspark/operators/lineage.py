"""Lineage graph: registration, impact, closure, coverage, audits and run tracking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.clock import AsOf, moment, on_day, since
from ..functions.ratios import count_where, percent
from ..session import drop_folder, scratch_path
from .common import union_all
from .forest import Steps, ancestors, between, blocks, circles, forest, running
from .upsert import upsert



def lineage_nodes(ds: DataFrame, nodes: DataFrame, as_of: AsOf, large_source: bool = False) -> DataFrame:
    """Node table after taking in the datasets touched on the day of ``as_of``.

    ``large_source``, as in ``upsert``, tells that about all datasets were touched.
    """
    rows = ds.where(on_day("updated_at", as_of)).select(
        F.col("dataset_id").alias("node_id"),
        F.lit("DATASET").alias("node_type"),
        F.col("dataset_id").alias("ref_id"),
        F.col("catalog_name").alias("name"),
        "description",
        "created_at",
        "updated_at",
    )
    updates = [c for c in ("name", "description", "updated_at") if c in nodes.columns]
    return upsert(nodes, rows, ["node_id"], updates, large_source=large_source)


def edge_rows(models: DataFrame, as_of: AsOf) -> DataFrame:
    """Edges from each model's ``depends_on`` list.

    A dependency is named by its last dotted part and looked up in the model's own
    database and schema; a name without a dot is skipped.
    """
    exploded = models.select(
        "database_name", "schema_name", "object_name", F.explode("depends_on").alias("dep")
    )
    parts = F.split("dep", r"\.")
    place = ("database_name", "schema_name")
    ends = exploded.where(F.size(parts) >= 2).select(
        labels.dataset_key(*place, F.element_at(parts, -1)).alias("src_node_id"),
        labels.dataset_key(*place, "object_name").alias("tgt_node_id"),
        F.concat(F.lit("dbt_model_"), "object_name").alias("logic_ref"),
    )
    return ends.distinct().select(
        labels.edge_key("src_node_id", "tgt_node_id").alias("edge_id"),
        "src_node_id",
        "tgt_node_id",
        F.lit("TRANSFORMS").alias("edge_type"),
        "logic_ref",
        F.lit(True).alias("active_flag"),
        moment(as_of).alias("created_at"),
        moment(as_of).alias("updated_at"),
    )


def lineage_edges(models: DataFrame, edges: DataFrame, as_of: AsOf) -> DataFrame:
    """Edge table after taking in the dependencies of ``models``."""
    updates = [c for c in ("logic_ref", "active_flag", "updated_at") if c in edges.columns]
    return upsert(edges, edge_rows(models, as_of), ["edge_id"], updates)


def impact_one_hop(nodes: DataFrame, edges: DataFrame, src: str) -> DataFrame:
    """Active direct dependants of ``src`` by node type.

    The dependency count of a target counts its edges before duplicates are removed.
    Parallel edges are counted per type first, so they cost one row each.
    """
    parallel = (
        edges.where((F.col("src_node_id") == src) & F.col("active_flag"))
        .groupBy("tgt_node_id", "edge_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    named = parallel.join(
        nodes.select(F.col("node_id").alias("tgt_node_id"), "name", "node_type"), "tgt_node_id"
    )
    per_target = Window.partitionBy("tgt_node_id")
    impacted = (
        named.withColumn("dependency_count", F.sum("n").over(per_target))
        .select("tgt_node_id", "name", "node_type", "edge_type", "dependency_count")
        .distinct()
    )
    return (
        impacted.groupBy("node_type")
        .agg(
            F.count(F.lit(1)).alias("impacted_assets"),
            F.avg("dependency_count").alias("avg_dependencies"),
            F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("asset_list"),
        )
        .orderBy(F.desc("impacted_assets"))
    )


class _Walk:
    """A folder with the edges and levels of one graph walk, as Parquet.

    Each level is written before the next one reads it, so plans stay short and a lost
    executor costs a re-read. Whether a side is broadcast is left to Spark, which knows the
    size of the files; hubs on a merged side are split by adaptive execution.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch_path(spark, "walk")

    def keep(self, df: DataFrame, *names: str) -> DataFrame:
        paths = [f"{self.folder}/{n}" for n in names]
        df.write.parquet(paths[0])
        return self.spark.read.schema(df.schema).parquet(paths[0])

    def levels(self, depth: int, schema) -> DataFrame:
        paths = [f"{self.folder}/level-{d}" for d in range(depth + 1)]
        return self.spark.read.schema(schema).parquet(*paths)

    def end(self, result: DataFrame, name: str) -> DataFrame:
        """The result in a folder of its own; the folder of the walk is removed."""
        path = scratch_path(self.spark, name)
        result.write.parquet(path)
        drop_folder(self.spark, self.folder)
        return self.spark.read.schema(result.schema).parquet(path)


def _grow(
    walk: _Walk, start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str],
    max_depth: int | None,
) -> DataFrame:
    """Repeats ``step`` on the newest rows until it adds none; rows keep their first depth.

    Only whether a level is empty returns to the driver.
    """
    frontier = walk.keep(start, "level-0")
    depth = 0
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        visited = walk.levels(depth, start.schema).select(*keys)
        depth += 1
        found = step(frontier).distinct().join(visited, list(keys), "left_anti")
        frontier = walk.keep(
            found.withColumn("depth", F.lit(depth)).select(*start.columns), f"level-{depth}"
        )
    return walk.levels(depth, start.schema)


def reachable(
    edges: DataFrame,
    seeds: DataFrame,
    direction: str = "downstream",
    max_depth: int | None = None,
    active_only: bool = True,
) -> DataFrame:
    """Nodes reachable from the ``node_id`` column of ``seeds``, with the least depth.

    Safe on cycles: a node is expanded once. Seeds themselves are not part of the result.
    """
    src, tgt = ("src_node_id", "tgt_node_id")
    if direction == "upstream":
        src, tgt = tgt, src
    elif direction != "downstream":
        raise ValueError(f"direction {direction!r} is neither upstream nor downstream")
    live = edges.where("active_flag") if active_only else edges
    walk = _Walk(edges.sparkSession)
    hops = walk.keep(
        live.select(F.col(src).alias("_from"), F.col(tgt).alias("_to"))
        .where("_from IS NOT NULL AND _to IS NOT NULL")
        .distinct(),
        "edges",
    )

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(hops, frontier["node_id"] == hops["_from"]).select(
            F.col("_to").alias("node_id")
        )

    start = seeds.select("node_id").distinct().withColumn("depth", F.lit(0))
    return walk.end(_grow(walk, start, step, ["node_id"], max_depth).where("depth > 0"), "reachable")


def manager_chain(party: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every party with each of its managers up the chain and their distance.

    By definition one row per party and ancestor; ``max_depth`` bounds it for long chains.
    """
    walk = _Walk(party.sparkSession)
    links = walk.keep(
        party.where("manager_party_id IS NOT NULL").select(
            F.col("party_id").alias("_from"), F.col("manager_party_id").alias("_to")
        ),
        "edges",
    )
    start = links.where("_from <> _to").select(
        F.col("_from").alias("party_id"), F.col("_to").alias("manager_id"), F.lit(1).alias("depth")
    )

    def step(frontier: DataFrame) -> DataFrame:
        return (
            frontier.join(links, frontier["manager_id"] == links["_from"])
            .select("party_id", F.col("_to").alias("manager_id"))
            .where("party_id <> manager_id")
        )

    rest = None if max_depth is None else max_depth - 1
    grown = _grow(
        walk, start.withColumn("depth", F.lit(0)), step, ["party_id", "manager_id"], rest
    )
    return walk.end(
        grown.select("party_id", "manager_id", (F.col("depth") + 1).alias("level")), "managers"
    )


def manager_tree(party: DataFrame) -> DataFrame:
    """The parties as intervals, see ``forest``: one row per party instead of one per ancestor."""
    return forest(party, "party_id", "manager_party_id")


def managers_of(tree: DataFrame) -> DataFrame:
    """The rows of ``manager_chain`` from the intervals of ``manager_tree``."""
    return ancestors(tree).select(
        F.col("node").alias("party_id"), F.col("above").alias("manager_id"), F.col("distance").cast("int").alias("level")
    )


def reports_of(tree: DataFrame) -> DataFrame:
    """Every party with the number of its managers, of its reports at all levels, and its top.

    Parties in a circle of managers are marked; their top is the smallest of the circle.
    """
    ring = circles(tree).select("node", F.lit(True).alias("circular"))
    return tree.join(ring, "node", "left").select(
        F.col("node").alias("party_id"), F.col("root").alias("top_id"), F.col("depth").alias("levels_up"),
        (F.col("size") - 1).alias("reports"), F.coalesce("circular", F.lit(False)).alias("circular"),
    )


# --- reachability by intervals ---------------------------------------------------------------


class ReachIndex(NamedTuple):
    """A spanning forest of a graph as intervals, and the edges that are not part of it."""

    nodes: DataFrame
    jumps: DataFrame


def reach_index(edges: DataFrame, direction: str = "downstream", active_only: bool = True) -> ReachIndex:
    """Index for ``reached_from``, built once and kept as two tables.

    Every node hangs below its smallest neighbour against the direction; circles are opened.
    What lies below a node in this forest is the numbers from its ``low`` to before its
    ``high``, so a walk needs a step only for an edge outside the forest. ``jumps`` has those
    edges, numbered by their sources: from ``first`` to before ``last`` of a node are those
    that start below it. They have the ``low`` of the source (``at``) and the interval of the target.
    """
    src, tgt = ("src_node_id", "tgt_node_id") if direction == "downstream" else ("tgt_node_id", "src_node_id")
    steps = Steps(edges.sparkSession, "reach")
    live = edges.where("active_flag") if active_only else edges
    hops = steps.keep(
        live.select(F.col(src).alias("parent"), F.col(tgt).alias("node"))
        .where("parent IS NOT NULL AND node IS NOT NULL AND parent <> node").distinct()
    )
    below = hops.groupBy("node").agg(F.min("parent").alias("parent"))
    tree = forest(below.unionByName(hops.select(F.col("parent").alias("node")).distinct(), allowMissingColumns=True))
    place = tree.select("node", F.col("parent").alias("up"), F.col("pre").alias("low"), (F.col("pre") + F.col("size")).alias("high"))
    outside = (
        hops.join(place, "node").where("NOT parent <=> up")
        .join(place.select(F.col("node").alias("parent"), F.col("low").alias("at")), "parent")
        .select("at", F.lit(1).alias("jump"), "low", "high")
    )
    inside = place.select(F.col("low").alias("at"), F.lit(0).alias("jump"), "node", "low", "high")
    ranked = steps.keep(running(inside.unionByName(outside, allowMissingColumns=True), "at", "jump", "before"))
    nodes = ranked.where("jump = 0").select("node", "low", "high", F.col("before").alias("first"))
    jumps = ranked.where("jump = 1").select(F.col("before").alias("number"), "at", "low", "high")
    ends = nodes.select(F.col("low").alias("high"), F.col("first").alias("last"))
    nodes = nodes.join(ends, "high", "left").select(
        "node", "low", "high", "first", F.coalesce("last", F.lit(jumps.count())).alias("last")
    )
    return ReachIndex(*steps.end(nodes, jumps))


def _widest(spans: DataFrame) -> DataFrame:
    """The spans of each seed that lie in no other one of it; those that are not ``fresh`` win.

    ``live`` marks the seeds that have a fresh one with edges to follow.
    """
    seed = Window.partitionBy("seed")
    before = seed.orderBy("low", "fresh").rowsBetween(Window.unboundedPreceding, -1)
    outer = spans.withColumn("_high", F.max("high").over(before)).where("_high IS NULL OR _high <= low").drop("_high")
    return outer.withColumn("live", F.max(F.col("fresh") & (F.col("leads") > 0)).over(seed))


def reached_from(index: ReachIndex, seeds: DataFrame) -> DataFrame:
    """(seed, node_id): all nodes that each ``node_id`` of ``seeds`` reaches, itself left out.

    Where the edges outside the forest lead from below a node is found once per node, and kept
    without what lies in another of its targets. A round adds these targets to all seeds that
    have met the node. A node that is a seed itself hands over all that it covers so far, so
    among seeds a round doubles the number of such edges in a row that have been followed. The
    spans of a seed are written once more only as long as it has edges to follow. The result is
    lazy: only spans of nodes are written.
    """
    steps = Steps(seeds.sparkSession, "reached")
    wanted = seeds.select(F.col("node_id").alias("node")).distinct().withColumn("wanted", F.lit(True))
    nodes = steps.keep(
        index.nodes.join(wanted, "node", "left")
        .withColumn("leads", F.when(F.col("first") == F.col("last"), 0).when(F.col("wanted"), 1).otherwise(2))
    )
    jumps = steps.keep(blocks(index.jumps.join(nodes.select("low", "leads"), "low").select("number", "low", "high", "leads"), "number"))

    def targets(starts: DataFrame) -> DataFrame:
        met = between(starts.select(F.col("low").alias("seed"), F.col("high").alias("_end"), "first", "last"), "first", "last", jumps)
        found = met.select("seed", "_end", "_row.low", "_row.high", "_row.leads").where("low < seed OR low >= _end")
        return found.drop("_end").withColumn("fresh", F.lit(True))

    start = nodes.where("wanted")
    own = start.select(F.col("low").alias("seed"), "low", "high", "leads", F.lit(False).alias("fresh"))
    known = steps.keep(_widest(own.unionByName(targets(start.where("leads = 1")))))
    rounds, others = [steps.count], []  # others: the targets of nodes that are no seeds
    while not (fresh := known.where("fresh AND leads > 0")).isEmpty():
        hands = steps.together(rounds, known.schema).where("NOT live").unionByName(known.where("live")).where("seed <> low")
        unseen = fresh.where("leads = 2").select("low").distinct()
        if others:
            opened = steps.together(others, known.schema).select(F.col("seed").alias("low"))
            unseen = unseen.join(opened, "low", "left_anti")
        if not unseen.isEmpty():
            steps.keep(_widest(targets(nodes.join(unseen, "low"))))
            others.append(steps.count)
        if others:
            hands = hands.unionByName(steps.together(others, known.schema))
        hands = hands.select(F.col("seed").alias("_by"), "low", "high", "leads")
        ends = fresh.select("seed", F.col("low").alias("_by")).join(hands, "_by").drop("_by").withColumn("fresh", F.lit(True))
        old = known.where("live").drop("live").withColumn("fresh", F.lit(False))
        known = steps.keep(_widest(old.unionByName(ends)))
        rounds.append(steps.count)
    rows = steps.keep(blocks(nodes.select("low", "node"), "low"))
    steps.leave([1, *rounds, steps.count])
    names = start.select(F.col("low").alias("seed"), F.col("node").alias("_seed"))
    spans = steps.together(rounds, known.schema).where("NOT live").join(names.hint("merge"), "seed")
    found = between(spans.select("_seed", "low", "high"), "low", "high", rows)
    return found.select(F.col("_seed").alias("seed"), F.col("_row.node").alias("node_id")).where("node_id <> seed")


def lineage_node_counts(nodes: DataFrame, as_of: AsOf, days: int = 1) -> DataFrame:
    return nodes.where(since("updated_at", as_of, days)).agg(
        F.count(F.lit(1)).alias("total_nodes"),
        count_where(F.col("node_type") == "DATASET").alias("dataset_nodes"),
    )


def _endpoints(edges: DataFrame) -> DataFrame:
    return union_all(
        [edges.select(F.col(c).alias("node_id")) for c in ("src_node_id", "tgt_node_id")]
    ).distinct()


def lineage_coverage(edges: DataFrame, ds: DataFrame) -> DataFrame:
    """Share of datasets that are an end of at least one edge."""
    ends = _endpoints(edges).select(F.col("node_id").alias("dataset_id"), F.lit(1).alias("linked"))
    return (
        ds.select("dataset_id")
        .join(ends, "dataset_id", "left")
        .agg(F.count(F.lit(1)).alias("total_datasets"), F.count("linked").alias("linked_datasets"))
        .withColumn("lineage_coverage_pct", percent("linked_datasets", "total_datasets"))
    )


def lineage_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends that name no registered node, one row per edge and side.

    Distinct ends are checked first: a hub is one row in the anti join.
    """
    missing = _endpoints(edges).join(nodes.select("node_id"), "node_id", "left_anti")
    sides = [
        edges.select("edge_id", F.col(c).alias("node_id"), F.lit(side).alias("side"))
        for side, c in (("SOURCE", "src_node_id"), ("TARGET", "tgt_node_id"))
    ]
    return union_all(sides).join(missing, "node_id").select("edge_id", "side", "node_id")


def lineage_roots_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without incoming edges, without outgoing edges, or without any."""
    out = edges.select(F.col("src_node_id").alias("node_id")).distinct()
    into = edges.select(F.col("tgt_node_id").alias("node_id")).distinct()
    place = (
        F.when(F.col("out").isNull() & F.col("into").isNull(), "ISOLATED")
        .when(F.col("into").isNull(), "ROOT")
        .when(F.col("out").isNull(), "LEAF")
    )
    return (
        nodes.select("node_id", "node_type")
        .join(out.withColumn("out", F.lit(1)), "node_id", "left")
        .join(into.withColumn("into", F.lit(1)), "node_id", "left")
        .select("node_id", "node_type", place.alias("position"))
        .where("position IS NOT NULL")
    )


# --- run tracking ------------------------------------------------------------------------


def run_changes(events: DataFrame) -> DataFrame:
    """One row per run: its earliest start ``s`` and its latest completion ``c``, if any."""
    start = F.struct("event_at", "process_id", F.upper("system_name").alias("system_id"))
    end = F.struct("event_at", "status", "error_message")
    return events.groupBy("run_id").agg(
        F.min(F.when(F.col("event") == "START", start)).alias("s"),
        F.max(F.when(F.col("event") == "COMPLETE", end)).alias("c"),
    )


def started_runs(events: DataFrame) -> DataFrame:
    """Started runs as run rows; a run without a completion is STARTED."""
    return _as_runs(run_changes(events).where("s IS NOT NULL"))


def _as_runs(changes: DataFrame) -> DataFrame:
    return changes.select(
        "run_id",
        F.col("s.process_id").alias("process_id"),
        F.col("s.system_id").alias("system_id"),
        F.col("s.event_at").alias("started_at"),
        F.col("c.event_at").alias("ended_at"),
        F.when(F.col("c").isNull(), "STARTED").otherwise(F.col("c.status")).alias("status"),
        F.col("c.error_message").alias("error_message"),
    )


def apply_run_events(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Run table after start and completion events.

    A start inserts a STARTED row unless the run exists; a completion sets status, end
    and error of a known run and is ignored for an unknown one. Both are taken in one
    step: a run that starts and completes in the same batch is inserted as completed. The
    events are aggregated once and meet the runs in one full join; rows without a run id
    pass it by.
    """
    changes = run_changes(events).where("run_id IS NOT NULL")
    known = runs.where("run_id IS NOT NULL").withColumn("_known", F.lit(True))
    joined = known.join(changes, "run_id", "full")
    new = _as_runs(joined.where("_known IS NULL AND s IS NOT NULL"))
    done = F.col("c").isNotNull()
    changed = {
        "ended_at": F.col("c.event_at"), "status": F.col("c.status"),
        "error_message": F.col("c.error_message"),
    }
    types = dict(runs.dtypes)
    old = joined.where("_known").select(
        *[
            F.when(done, changed[c].cast(types[c])).otherwise(F.col(c)).alias(c)
            if c in changed else F.col(c)
            for c in runs.columns
        ]
    )
    return old.unionByName(new, allowMissingColumns=True).unionByName(
        runs.where("run_id IS NULL"), allowMissingColumns=True
    )


def systems_from_events(dim_system: DataFrame, events: DataFrame) -> DataFrame:
    """System table with the systems that events name for the first time."""
    new = (
        events.where("event = 'START' AND system_name IS NOT NULL")
        .groupBy(F.upper("system_name").alias("system_id"))
        .agg(F.min("system_name").alias("system_name"))
        .select("system_id", "system_name", F.lit("ETL_TOOL").alias("system_type"))
    )
    return upsert(dim_system, new, ["system_id"], update_cols=[])


def one_shot_run(runs: DataFrame, as_of: AsOf, run_id: str, process_id: str, minutes: int = 30):
    """Run table with a finished run whose start is back-dated by ``minutes``."""
    end = moment(as_of)
    row = runs.sparkSession.range(1).select(
        F.lit(run_id).alias("run_id"),
        F.lit(process_id).alias("process_id"),
        (end - F.make_dt_interval(mins=F.lit(minutes))).alias("started_at"),
        end.alias("ended_at"),
        F.lit("SUCCESS").alias("status"),
    )
    return runs.unionByName(row, allowMissingColumns=True)
