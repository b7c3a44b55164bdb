"""When to stop drawing attacks: Wilson half-widths per chunk, and a plateau that holds."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netfell.functions.expressions import hazen, wilson_half_width
from netfell.operators.percolation import hits, participation
from netfell.scratch import Scratch


@dataclass(frozen=True)
class ConvergeParams:
    """Defaults of the converging simulation."""

    max_attacks: int = 10_000_000
    chunk_size: int = 10_000
    start: float = 0.05
    enforce: bool = True
    range_tol: float = 0.005
    slope_tol: float = 1e-7
    window: int = 5
    stable: int = 3
    seed: int = 12345
    thresh_prop: float = 0.05
    quantile: float = 0.95


PRESETS = {
    "default": ConvergeParams(),
    "network": ConvergeParams(enforce=False, thresh_prop=1.0, max_attacks=100_000_000),
    "subject_5pct": replace(ConvergeParams(), max_attacks=100_000_000),
}


def history(hit: DataFrame, nodes: DataFrame, chunk_size: int, quantile: float = 0.95) -> DataFrame:
    """graph_id, chunk, n_attacks and hw95 after each chunk, from hits by chunk.

    Counts run up over chunks, so a (step, node) cell that a chunk does not touch still has its earlier counts: cells are
    filled for every chunk from the first. Half-widths of steps that no attack has reached are NULL and left out."""
    chunks = hit.select("graph_id", "chunk").distinct()
    seen = hit.select("graph_id", "step").distinct().join(nodes.select("graph_id", "node"), "graph_id")
    cells = chunks.join(seen, "graph_id").join(hit, ["graph_id", "chunk", "step", "node"], "left").fillna({"k": 0})
    steps = chunks.join(seen.select("graph_id", "step").distinct(), "graph_id")
    n = steps.join(_chunk_counts(hit), ["graph_id", "chunk", "step"], "left").fillna({"n": 0})
    so_far = lambda keys: Window.partitionBy("graph_id", *keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    running_n = n.select("graph_id", "chunk", "step", F.sum("n").over(so_far(["step"])).alias("n"))
    running_k = cells.select("graph_id", "chunk", "step", "node", F.sum("k").over(so_far(["step", "node"])).alias("k"))
    widths = running_k.join(running_n, ["graph_id", "chunk", "step"]).select("graph_id", "chunk", wilson_half_width(F.col("k"), F.col("n")).alias("hw"))
    out = widths.groupBy("graph_id", "chunk").agg(hazen(F.collect_list("hw"), quantile).alias("hw95"))
    return out.select("graph_id", "chunk", ((F.col("chunk") + 1) * chunk_size).alias("n_attacks"), "hw95")


def _chunk_counts(hit: DataFrame) -> DataFrame:
    return hit.groupBy("graph_id", "chunk", "step").agg((F.sum("k") / F.col("step")).cast("long").alias("n"))


def plateau(conv: DataFrame, window: int = 5, start: float = 0.05, range_tol: float = 0.005, slope_tol: float = 1e-7, enforce: bool = True) -> DataFrame:
    """conv with win_mean, win_range and win_slope over the last ``window`` chunks (at least 3; NULL before there are as
    many), and is_plateau."""
    window = max(3, window)
    last = Window.partitionBy("graph_id").orderBy("chunk").rowsBetween(-(window - 1), 0)
    full = F.count("hw95").over(last) == window
    made = conv.withColumns(
        {
            "win_mean": F.when(full, F.avg("hw95").over(last)),
            "win_range": F.when(full, F.max("hw95").over(last) - F.min("hw95").over(last)),
            "win_slope": F.when(full, F.regr_slope("hw95", "n_attacks").over(last)),
        }
    )
    flat = (F.col("win_range") < range_tol) & (F.abs("win_slope") < slope_tol)
    if enforce:
        flat &= F.col("win_mean") < start
    return made.withColumn("is_plateau", F.coalesce(flat, F.lit(False)))


def run_lengths(flags: DataFrame) -> DataFrame:
    """flags with run: how many chunks in a row up to this one are plateaus."""
    so_far = Window.partitionBy("graph_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    broken = F.sum((~F.col("is_plateau")).cast("int")).over(so_far)
    marked = flags.withColumn("island", broken)
    inside = Window.partitionBy("graph_id", "island").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("run", F.sum(F.col("is_plateau").cast("int")).over(inside).cast("int")).drop("island")


def stop_chunk(runs: DataFrame, stable: int = 3) -> DataFrame:
    """graph_id, the first chunk whose run is long enough (NULL if none is) and the attacks used until then."""
    last = runs.groupBy("graph_id").agg(F.min(F.when(F.col("run") >= stable, F.col("chunk"))).alias("stop_chunk"), F.max("n_attacks").alias("most"), F.min(F.when(F.col("run") >= stable, F.col("n_attacks"))).alias("at"))
    return last.select("graph_id", "stop_chunk", F.coalesce("at", "most").alias("final_attacks"), F.col("stop_chunk").isNotNull().alias("converged"))


def converge(edges: DataFrame, nodes: DataFrame, params: ConvergeParams = ConvergeParams(), rule: str = "philox") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Draw attacks chunk by chunk until every graph's plateau holds, or max_attacks. Returns participation, history
    and stop of every graph.

    A round draws as many chunks as a stop takes at least, and then a quarter of those so far, so that rounds grow with
    the logarithm of the run. Plateaus are looked for chunk by chunk all the same, and what was drawn beyond a graph's
    stop is left out. Each round adds to written totals of one row a (graph, step, node); earlier chunks are not looked
    at again, and graphs that have stopped draw no more."""
    scratch, most, chunk = Scratch(nodes.sparkSession, "converge"), max(1, params.max_attacks // params.chunk_size), 0
    step, totals, conv, stops, left = min(most, max(3, params.window) + params.stable - 1), None, None, None, nodes
    while chunk < most:
        some = min(step, most - chunk)
        drawn = hits(_of(edges, left), left, some * params.chunk_size, params.seed, rule, chunk * params.chunk_size, params.chunk_size)
        drawn = scratch.write(drawn, f"hits-{chunk}")
        before = drawn if totals is None else drawn.unionByName(_of(totals, left).withColumn("chunk", F.lit(-1).cast("long")))
        new = history(before, left, params.chunk_size, params.quantile).where("chunk >= 0")
        conv = scratch.write(new if conv is None else conv.unionByName(new), f"history-{chunk}")
        flags = plateau(conv, params.window, params.start, params.range_tol, params.slope_tol, params.enforce)
        stops = scratch.write(stop_chunk(run_lengths(flags), params.stable), f"stops-{chunk}")
        used = drawn.join(F.broadcast(stops.select("graph_id", "stop_chunk")), "graph_id").where("stop_chunk IS NULL OR chunk <= stop_chunk").select("graph_id", "step", "node", "k")
        added = used if totals is None else totals.unionByName(used)
        totals = scratch.write(added.groupBy("graph_id", "step", "node").agg(F.sum("k").alias("k")), f"totals-{chunk}")
        chunk += some
        step = max(1, chunk // 4)
        unfinished = stops.where("stop_chunk IS NULL").select("graph_id")
        if unfinished.isEmpty():
            break
        left = nodes.join(F.broadcast(unfinished), "graph_id", "left_semi")
    used_until = F.broadcast(stops.select("graph_id", "stop_chunk"))
    conv = conv.join(used_until, "graph_id").where("stop_chunk IS NULL OR chunk <= stop_chunk").drop("stop_chunk")
    return participation(totals, nodes), conv, stops


def _of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select("graph_id").distinct(), "graph_id", "left_semi")

