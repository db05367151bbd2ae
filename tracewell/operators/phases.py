"""Phase picks: compressed row lists, joins to traces, empty gathers, projection to a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def csr_faults(indptr: Column, data: Column, n_traces: Column | None = None) -> Column:
    """What is wrong with a compressed row list (array<long> each), in a fixed order; empty if nothing is."""
    n = F.size(indptr)
    falling = F.exists(F.sequence(F.lit(1), n - 1), lambda k: F.get(indptr, k) < F.get(indptr, k - 1))
    found = [
        F.when(n < 1, F.lit("empty")),
        F.when(F.get(indptr, F.lit(0)) != 0, F.lit("start")),
        F.when((n > 1) & falling, F.lit("falling")),
        F.when(F.get(indptr, n - 1) != F.size(data), F.lit("length")),
    ]
    if n_traces is not None:
        found.append(F.when(n != n_traces + 1, F.lit("traces")))
    return F.array_compact(F.array(*found))


def csr_to_picks(rows: DataFrame, keys: list[str], indptr: str, data: str, phase: str) -> DataFrame:
    """keys, trace_idx, phase, pick: one row a pick of lists (keys, indptr, data).

    Bounds are clipped, as Spark may cut lists before a filter by csr_faults.
    """
    cut = lambda z, k: F.slice(F.col(data), F.greatest(F.get(F.col(indptr), k) + 1, F.lit(1)).cast("int"), F.greatest(z - F.get(F.col(indptr), k), F.lit(0)).cast("int"))
    lists = rows.select(*keys, F.transform(F.slice(indptr, F.lit(2), F.size(indptr)), cut).alias("_p"))
    # the outer form: for the inner one Spark filters by the size of the list first, with every column inlined
    each = lists.select(*keys, F.posexplode_outer("_p").alias("trace_idx", "_p"))
    return each.select(*keys, F.col("trace_idx").cast("long").alias("trace_idx"), F.lit(phase).alias("phase"), F.explode("_p").alias("pick"))


def picks_to_csr(traces: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, indptr, data of long picks (keys, trace_idx, pick); traces without a pick have an empty row."""
    each = traces.select(*keys, "trace_idx").join(picks.groupBy(*keys, "trace_idx").agg(F.sort_array(F.collect_list("pick")).alias("p")), [*keys, "trace_idx"], "left")
    each = each.withColumn("p", F.coalesce("p", F.expr("cast(array() as array<bigint>)")))
    each = each.withColumn("z", F.sum(F.size("p")).over(Window.partitionBy(*keys).orderBy("trace_idx")))
    whole = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("trace_idx", "z", "p"))).alias("t"))
    indptr = F.concat(F.array(F.lit(0).cast("long")), F.transform("t", lambda x: x["z"]))
    return whole.select(*keys, indptr.alias("indptr"), F.flatten(F.transform("t", lambda x: x["p"])).alias("data"))


def with_picks(rows: DataFrame, picks: DataFrame, keys: list[str], phases: tuple[str, ...] = ("P", "S")) -> DataFrame:
    """rows with an array of sorted picks per phase (p_picks, s_picks); rows without any, padding too, have empty arrays."""
    none = F.expr("cast(array() as array<bigint>)")
    lists = picks.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(F.col("phase") == p, F.col("pick")))).alias(f"{p.lower()}_picks") for p in phases])
    out = rows.join(lists, keys, "left")
    return out.withColumns({f"{p.lower()}_picks": F.coalesce(f"{p.lower()}_picks", none) for p in phases})


def with_first_breaks(traces: DataFrame, breaks: DataFrame, keys: list[str]) -> DataFrame:
    """One first break (fb) a trace by position; any trace or break without its partner is an error when the row is read."""
    found = traces.withColumn("_trace", F.lit(True)).join(breaks.select(*keys, "fb"), keys, "full_outer")
    missing = F.col("_trace").isNull() | F.col("fb").isNull()
    return found.withColumn("fb", F.when(missing, F.raise_error(F.lit("traces and first breaks differ in length"))).otherwise(F.col("fb"))).drop("_trace")


def unmatched(traces: DataFrame, breaks: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, n_traces, n_breaks, unmatched: where traces and first breaks do not pair."""
    t = traces.select(*keys).withColumn("t", F.lit(1))
    b = breaks.select(*keys).withColumn("b", F.lit(1))
    both = t.join(b, keys, "full_outer").groupBy(*by)
    out = both.agg(F.count("t").alias("n_traces"), F.count("b").alias("n_breaks"), F.sum((F.col("t").isNull() | F.col("b").isNull()).cast("long")).alias("unmatched"))
    return out.where("unmatched > 0")


def with_a_pick(rows: DataFrame, keys: list[str], p_first: str, s_first: str) -> DataFrame:
    """Rows of windows in which some trace has a P or an S pick."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("_any", F.max(F.greatest(p_first, s_first)).over(w)).where("_any > 0").drop("_any")


def project_picks(picks: Column, factor: float, start: int, width: int, shift: Column | None = None) -> Column:
    """Picks of a list in a view: stretched (rounded half to even), cut at start, moved by shift; those outside 1 .. width - 1 go."""
    moved = lambda p: F.rint(p * factor).cast("long") - start + (F.lit(0) if shift is None else shift)
    return F.array_sort(F.filter(F.transform(F.filter(picks, lambda p: p > 0), moved), lambda p: (p > 0) & (p < width)))
