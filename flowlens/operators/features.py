"""Per-flow features: sizes, rates, inter-arrival times, bursts and the size histogram.

Order-dependent features never gather a flow of many packets in one task. Packets are windowed inside
(flow, chunk), where a chunk is a fixed range of packet positions, and only chunk edges are
stitched together per flow. A flow of no more packets than a chunk is one chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.contract import (
    BURST_WINDOW_SECONDS,
    FEATURE_NAMES,
    FEATURE_SCHEMA_VERSION,
    HISTOGRAM_EDGES,
)
from flowlens.functions.keys import CHUNK_ROWS, chunk_of
from flowlens.functions.numeric import round_half_even
from flowlens.operators.flows import FLOW, build_flows, with_flow_pair


def histogram_labels(edges: tuple[int, ...] = HISTOGRAM_EDGES) -> list[str]:
    """Bucket labels. They read as upper-inclusive while counting is lower-inclusive (size 64
    counts under ``65-256``); kept because exported histograms carry them."""
    closed = [f"{low + 1}-{high}" for low, high in zip(edges, edges[1:], strict=False)]
    return [*closed, f">{edges[-1]}"]


def _size_aggregates(n: Column) -> list[Column]:
    """Aggregates per flow over rows that stand for ``n`` packets of one ``length`` each."""
    length = F.col("length")
    bounds = [*HISTOGRAM_EDGES, None]
    buckets = [
        F.sum(
            F.when(
                (length >= low) & (F.lit(True) if high is None else length < high),
                n,
            ).otherwise(0)
        ).alias(f"bucket_{i}")
        for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False))
    ]
    return [
        F.sum(n).alias("n"),
        F.sum(length * n).alias("total"),
        F.sum(length.cast("decimal(12,0)") * length.cast("decimal(12,0)") * n)
        .cast("decimal(38,0)")
        .alias("squares"),
        F.min("length").alias("packet_size_min"),
        F.max("length").alias("packet_size_max"),
        F.percentile("length", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n).alias("q"),
        *buckets,
    ]


def _size_columns(stats: DataFrame, *kept: str) -> DataFrame:
    """``kept`` and the size features out of ``_size_aggregates``."""
    n = F.col("n").cast("double")
    spread = (
        F.col("n").cast("decimal(18,0)") * F.col("squares")
        - (F.col("total").cast("decimal(19,0)") * F.col("total").cast("decimal(19,0)"))
    ).cast("double")
    raw = stats.select(
        *FLOW,
        *kept,
        "packet_size_min",
        "packet_size_max",
        (F.col("total").cast("double") / n).alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(spread / (n * (n - 1.0)))).alias("std"),
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"),
        F.array(
            *[
                F.struct(
                    F.lit(label).alias("range"),
                    F.col(f"bucket_{i}").alias("count"),
                    round_half_even(f"cast(bucket_{i} as double) / n", 4).alias("share"),
                )
                for i, label in enumerate(histogram_labels())
            ]
        ).alias("packet_size_histogram"),
    )
    return raw.select(
        *FLOW,
        *kept,
        round_half_even("mean", 2).alias("packet_size_mean"),
        round_half_even("p50", 2).alias("packet_size_median"),
        round_half_even("std", 2).alias("packet_size_std"),
        "packet_size_min",
        "packet_size_max",
        round_half_even("p25", 2).alias("packet_size_p25"),
        round_half_even("p75", 2).alias("packet_size_p75"),
        "packet_size_histogram",
    )


def size_features(packets: DataFrame) -> DataFrame:
    """Size statistics and histogram per flow.

    Sizes collapse to (flow, length, count) first; a packet length has at most a few ten thousand
    values, so the exact percentile state is bounded however many packets a flow has. The
    deviation uses exact integer sums.
    """
    lengths = (
        with_flow_pair(packets)
        .groupBy(*FLOW, F.col("length").cast("bigint").alias("length"))
        .agg(F.count("*").alias("n"))
    )
    return _size_columns(lengths.groupBy(*FLOW).agg(*_size_aggregates(F.col("n"))))


def _in_chunks(packets: DataFrame, chunk_rows: int) -> DataFrame:
    """Packets of a flow in packet order, windowed per (flow, chunk) with the neighbouring stamps."""
    order = Window.partitionBy(*FLOW, "chunk").orderBy("packet_id")
    return (
        with_flow_pair(packets)
        .select(*FLOW, "packet_id", "ts", chunk_of(F.col("packet_id"), chunk_rows).alias("chunk"))
        .withColumn("previous_ts", F.lag("ts").over(order))
        .withColumn("next_ts", F.lead("ts").over(order))
    )


def interarrivals(packets: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Gap of every packet to its predecessor in the flow, never negative.

    Gaps inside chunks come from a window per (flow, chunk). The one gap per chunk that crosses
    its edge comes from a window per flow over the first and last packets of chunks only. First
    packets of flows have none.
    """
    chunked = _in_chunks(packets, chunk_rows)
    edges = chunked.where("previous_ts is null or next_ts is null").withColumn(
        "before", F.lag("ts").over(Window.partitionBy(*FLOW).orderBy("packet_id"))
    )
    crossing = edges.where("previous_ts is null and before is not null")
    gap = "greatest(ts - {}, 0e0) as interarrival"
    return (
        chunked.where("previous_ts is not null")
        .selectExpr(*FLOW, "packet_id", gap.format("previous_ts"))
        .unionByName(crossing.selectExpr(*FLOW, "packet_id", gap.format("before")))
    )


#: buckets of gaps in each factor of e, and the bucket of gaps of zero
_BUCKETS, _ZERO = 2048, -1_000_000


def _gap_buckets(counted: DataFrame) -> DataFrame:
    """(flow, bucket) sums of (flow, gap, count): buckets ascend with the gap and are 0.05 % wide.

    ``first`` and ``second`` sum the distances from the bucket's own ``point``, which are small, so that
    moments of the flow come out of them without cancellation.
    """
    bucket = f"if(interarrival = 0, {_ZERO}, cast(floor(ln(interarrival) * {_BUCKETS}) as int)) as bucket"
    placed = counted.selectExpr(*FLOW, "interarrival", "n", bucket)
    placed = placed.selectExpr("*", f"if(bucket = {_ZERO}, 0e0, exp(cast(bucket as double) / {_BUCKETS})) as point")
    away = F.col("interarrival") - F.col("point")
    return placed.groupBy(*FLOW, "bucket", "point").agg(
        F.sum("n").alias("n"),
        F.sum(away * F.col("n")).alias("first"),
        F.sum(away * away * F.col("n")).alias("second"),
        F.min("interarrival").alias("low"),
        F.max("interarrival").alias("high"),
    )


def _median_gaps(counted: DataFrame, reached: DataFrame) -> DataFrame:
    """Median gap per flow: the values at the two middle ranks, looked for in their buckets only.

    ``reached`` holds each bucket's count, the flow's ``total`` and the gaps up to the bucket's end (``upto``).
    """
    ranks = reached.selectExpr(
        *FLOW, "bucket", "upto - n as before", "upto",
        "explode(array_distinct(array((total + 1) div 2, total div 2 + 1))) as rank",
    ).where("rank > before and rank <= upto")
    bucket = f"if(interarrival = 0, {_ZERO}, cast(floor(ln(interarrival) * {_BUCKETS}) as int)) as bucket"
    order = Window.partitionBy(*FLOW, "bucket", "rank").orderBy("interarrival")
    inside = counted.selectExpr(*FLOW, "interarrival", "n as gaps", bucket).join(ranks, [*FLOW, "bucket"])
    inside = inside.withColumn("passed", F.col("before") + F.sum("gaps").over(order))
    at = inside.where("passed >= rank and passed - gaps < rank")
    return at.groupBy(*FLOW).agg(((F.min("interarrival") + F.max("interarrival")) / 2.0).alias("median"))


def _gap_columns() -> list[Column]:
    """Gap features out of their unrounded values."""
    return [
        round_half_even("mean", 6).alias("interarrival_mean"),
        round_half_even("median", 6).alias("interarrival_median"),
        round_half_even("std", 6).alias("interarrival_std"),
        F.col("interarrival_min"),
        F.col("interarrival_max"),
    ]


def interarrival_features(packets: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Inter-arrival statistics per flow, however many gaps one flow has.

    Gaps collapse to (flow, gap, count), spread by gap, and those to (flow, bucket): 2048 buckets for
    every factor of e, some 60 000 between microseconds and a year. Windows run over a flow's buckets for
    the moments and for the bucket of the middle ranks, and over that one bucket's distinct gaps for the
    exact median: epoch stamps are doubles on a 2^-22 s grid, so that are about 2000 for each second of the gap.
    """
    counted = (
        interarrivals(packets, chunk_rows)
        .groupBy(*FLOW, "interarrival")
        .agg(F.count("*").alias("n"))
    )
    whole = Window.partitionBy(*FLOW)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = (
        _gap_buckets(counted)
        .withColumn("total", F.sum("n").over(whole))
        .withColumn("sum", F.sum(F.col("point") * F.col("n") + F.col("first")).over(whole))
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("mean", F.col("sum") / F.col("total").cast("double"))
    )
    offset = F.col("point") - F.col("mean")
    stats = reached.groupBy(*FLOW).agg(
        F.first("mean").alias("mean"),
        F.sum(F.col("second") + 2.0 * offset * F.col("first") + offset * offset * F.col("n")).alias("squares"),
        F.sum("n").cast("double").alias("n"),
        F.min("low").alias("interarrival_min"),
        F.max("high").alias("interarrival_max"),
    )
    std = F.when(F.col("n") > 1, F.sqrt(F.greatest("squares", F.lit(0.0)) / (F.col("n") - 1.0)))
    raw = stats.withColumn("std", std).join(_median_gaps(counted, reached), FLOW)
    return raw.select(*FLOW, *_gap_columns())


def burst_islands(
    packets: DataFrame, window: float = BURST_WINDOW_SECONDS, chunk_rows: int = CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Runs of packets whose gaps stay within ``window``, as two frames.

    The first holds finished runs: those strictly inside one chunk. The second holds the runs
    stitched from pieces that touch chunk edges (at most two pieces per chunk). A negative gap
    continues a run. Columns: flow, size, duration.
    """
    order = Window.partitionBy(*FLOW, "chunk").orderBy("packet_id")
    chunked = _in_chunks(packets, chunk_rows)
    opens = F.when(F.col("ts") - F.col("previous_ts") > window, 1).otherwise(0)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = (
        chunked.withColumn("piece", F.sum(opens).over(running))
        .groupBy(*FLOW, "chunk", "piece")
        .agg(
            F.count("*").alias("size"),
            F.min_by("ts", "packet_id").alias("first_ts"),
            F.max_by("ts", "packet_id").alias("last_ts"),
        )
        .withColumn("last_piece", F.max("piece").over(Window.partitionBy(*FLOW, "chunk")))
    )
    inner = (F.col("piece") > 0) & (F.col("piece") < F.col("last_piece"))
    duration = F.greatest(F.col("last_ts") - F.col("first_ts"), F.lit(0.0)).alias("duration")
    finished = pieces.where(inner).select(*FLOW, "size", duration)

    flow_order = Window.partitionBy(*FLOW).orderBy("chunk", "piece")
    gap = F.col("first_ts") - F.lag("last_ts").over(flow_order)
    # two pieces of one chunk are apart by construction; only chunk edges are compared
    opens_run = F.when(F.col("piece") > 0, 1).when(gap > window, 1).otherwise(0)
    stitched = (
        pieces.where(~inner)
        .withColumn("opens", opens_run)
        .withColumn(
            "run",
            F.sum("opens").over(
                flow_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .groupBy(*FLOW, "run")
        .agg(
            F.sum("size").alias("size"),
            F.min_by("first_ts", F.struct("chunk", "piece")).alias("first_ts"),
            F.max_by("last_ts", F.struct("chunk", "piece")).alias("last_ts"),
        )
        .select(*FLOW, "size", duration)
    )
    return finished, stitched


def _burst_aggregates(is_burst: Column) -> list[Column]:
    """Aggregates per flow over runs of ``size`` packets and ``duration``."""
    return [
        F.sum(is_burst.cast("bigint")).cast("double").alias("bursts"),
        F.coalesce(F.sum(F.when(is_burst, F.col("size"))), F.lit(0)).cast("double").alias("in_bursts"),
        F.coalesce(F.max(F.when(is_burst, F.col("size"))), F.lit(0)).cast("double").alias("largest"),
        F.coalesce(F.sum(F.when(is_burst, F.col("duration"))), F.lit(0.0)).alias("durations"),
    ]


def _burst_columns() -> list[Column]:
    """Burst features out of ``_burst_aggregates`` and the flow's ``packets``."""
    return [
        F.col("bursts").alias("burst_count"),
        round_half_even("in_bursts / packets", 4).alias("burst_packets_ratio"),
        round_half_even("in_bursts / greatest(bursts, 1e0)", 2).alias("burst_mean_size"),
        F.col("largest").alias("burst_max_size"),
        round_half_even("durations / greatest(bursts, 1e0)", 6).alias("burst_mean_duration"),
    ]


def burst_features(
    packets: DataFrame, window: float = BURST_WINDOW_SECONDS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Burst statistics per flow; a burst is a run of at least two packets. Zeros when none."""
    finished, stitched = burst_islands(packets, window, chunk_rows)
    stats = finished.unionByName(stitched).groupBy(*FLOW).agg(
        F.sum("size").cast("double").alias("packets"), *_burst_aggregates(F.col("size") >= 2)
    )
    return stats.select(*FLOW, *_burst_columns())


def flow_rates(flows: DataFrame) -> DataFrame:
    """Counts, rates (NULL when the flow has no duration) and the upstream share."""
    return flows.select(
        *FLOW,
        "flow_key",
        "packet_count",
        "byte_count",
        round_half_even("duration", 6).alias("duration_seconds"),
        round_half_even("packet_count / nullif(duration, 0e0)", 4).alias("packets_per_second"),
        round_half_even("byte_count / nullif(duration, 0e0)", 2).alias("bytes_per_second"),
        "upstream_packets",
        "downstream_packets",
        "upstream_bytes",
        "downstream_bytes",
        round_half_even("upstream_packets / packet_count", 4).alias("direction_ratio"),
    )


def _short_flow_features(rows: DataFrame, window: float) -> DataFrame:
    """Size, gap and burst features of flows that one task may hold, by one shuffle of their packets.

    ``rows`` carry their flow. The values are those of ``size_features``, ``interarrival_features`` and
    ``burst_features`` with a flow as one chunk.
    """
    order = Window.partitionBy(*FLOW).orderBy("packet_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ts, previous = F.col("ts"), F.col("previous_ts")
    placed = rows.select(*FLOW, "packet_id", "ts", F.col("length").cast("bigint").alias("length")).withColumns(
        {
            "previous_ts": F.lag("ts").over(order),
            "next_ts": F.lead("ts").over(order),
            "is_last": F.lead(F.lit(1)).over(order).isNull(),
            "place": F.row_number().over(order),
            "flow_ts": F.first("ts").over(so_far),
        }
    )
    edge = previous.isNull() | F.col("next_ts").isNull()
    opens = ts - previous > window
    linked = placed.withColumns(
        {
            # of packets without a stamp between others; a stamp may be missing itself, so it is wrapped
            "before": F.last(F.when(edge, F.struct("ts")), ignorenulls=True).over(earlier)["ts"],
            "start": F.coalesce(F.max(F.when(opens, F.col("place"))).over(so_far), F.lit(1)),
            "start_ts": F.coalesce(F.last(F.when(opens, ts), ignorenulls=True).over(so_far), F.col("flow_ts")),
        }
    )
    # a run of packets stands in its last one
    ends = F.col("is_last") | F.coalesce(F.col("next_ts") - ts > window, F.lit(False))
    judged = linked.select(
        *FLOW,
        "length",
        F.expr(
            "case when previous_ts is not null then greatest(ts - previous_ts, 0e0) "
            "when before is not null then greatest(ts - before, 0e0) end"
        ).alias("gap"),
        F.when(ends, F.col("place") - F.col("start") + 1).cast("bigint").alias("size"),
        F.greatest(ts - F.col("start_ts"), F.lit(0.0)).alias("duration"),
    )
    stats = judged.groupBy(*FLOW).agg(
        *_size_aggregates(F.lit(1)),
        F.avg("gap").alias("mean"),
        F.median("gap").alias("median"),
        F.stddev_samp("gap").alias("std"),
        F.min("gap").alias("interarrival_min"),
        F.max("gap").alias("interarrival_max"),
        F.count("*").cast("double").alias("packets"),
        *_burst_aggregates(F.coalesce(F.col("size") >= 2, F.lit(False))),
    )
    timed = stats.select("*", *_gap_columns()[:3], *_burst_columns())
    return _size_columns(
        timed,
        *[f"interarrival_{x}" for x in ("mean", "median", "std", "min", "max")],
        *[f"burst_{x}" for x in ("count", "packets_ratio", "mean_size", "max_size", "mean_duration")],
    )


def flow_features(
    packets: DataFrame,
    flows: DataFrame | None = None,
    window: float = BURST_WINDOW_SECONDS,
    chunk_rows: int = CHUNK_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """All 27 scalar features, the histogram and the schema version per flow.

    Flows of at most ``chunk_rows`` packets, nearly all of them, take their features from one shuffle
    of their packets. Only the packets of the others, one flow for every ``chunk_rows`` packets at most, go through
    the operators that never gather a flow in one task; without such flows adaptive execution drops that
    branch before it reads anything. With ``longest``, the packets of the longest flow if that is known, it is
    not even planned when there are none.
    """
    base = flow_rates(build_flows(packets) if flows is None else flows)
    is_long = (F.col("packet_count") > chunk_rows) if chunk_rows > 0 else F.lit(False)
    longer = F.broadcast(base.where(is_long).select(*FLOW))
    rows = with_flow_pair(packets)
    columns = [
        *FLOW,
        "flow_key",
        *FEATURE_NAMES,
        "packet_size_histogram",
        F.lit(FEATURE_SCHEMA_VERSION).alias("feature_schema_version"),
    ]
    if longest is not None and (chunk_rows <= 0 or longest <= chunk_rows):
        return base.join(_short_flow_features(rows, window), FLOW, "left").select(*columns)
    short = _short_flow_features(rows.join(longer, FLOW, "left_anti"), window)
    hot = rows.join(longer, FLOW, "left_semi").drop("flow_pair")
    parts = [
        size_features(hot),
        interarrival_features(hot, chunk_rows),
        burst_features(hot, window, chunk_rows),
    ]
    split = reduce(lambda left, right: left.join(right, FLOW, "left"), parts, base.where(is_long))
    return base.where(~is_long).join(short, FLOW, "left").select(*columns).unionByName(split.select(*columns))
