"""Distinct counts and quantiles from small sketches kept by run, and exact quantiles narrowed by bins.

A run's rows are read once: ``run_sketches`` keeps the row count, a HyperLogLog sketch of the ids and a KLL sketch of the
values. Any range of runs, overlapping ones too, is then answered from sketches (some kilobytes each), without its events.
Ids that are null and values that are null or NaN are not in the sketches; both are counted among ``n``.
"""

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# 2**14 registers: a standard error of 0.8 %. KLL with k = 1600: ranks within about 0.2 %.
LG_REGISTERS, KLL_K = 14, 1_600
# Bins of a pass over the values, and the number of values whose counts a driver may read at last.
BINS, LEFT = 64, 10_000


def run_sketches(
    rows: DataFrame, by: list[str], id: str, value: str, lg_registers: int = LG_REGISTERS, k: int = KLL_K
) -> DataFrame:
    """(by..., n, ids, values_): one row per run. Sketches are built map-side, so a hot run is no large task."""
    number = F.col(value).cast("double")
    held = F.when(~F.isnan(number), number)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(id).cast("string"), lg_registers).alias("ids"),
        F.kll_sketch_agg_double(held, k).alias("values_"),
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups: those of the runs of each, united."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("values_").alias("values_")
    )


def over_ranges(sketches: DataFrame, ranges: DataFrame, by: list[str], run: str = "run_ts") -> DataFrame:
    """(range columns, by..., n, ids, values_) of each row of ``ranges`` (start, end, end exclusive, and others).

    ``ranges`` is a small table of asked spans; it is joined to the sketches, of which there is one per run, not to events.
    """
    inside = (F.col(run) >= F.col("start")) & (F.col(run) < F.col("end"))
    return merged(sketches.join(ranges, inside), [*ranges.columns, *by])


def distinct_ids(sketch: str = "ids"):
    """Estimated number of different ids."""
    return F.hll_sketch_estimate(sketch)


def quantile(q: float, sketch: str = "values_"):
    """Estimated quantile; null of a sketch without values."""
    some = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col(sketch)), F.lit(q)))


def _bins(edges: list[float]):
    """Number of a value's bin: 2i + 1 is edge i itself, 2i what lies before it. Nested comparisons, which Spark compiles."""

    def among(first: int, end: int):
        if first == end:
            return F.lit(2 * first)
        at = (first + end) // 2
        edge = F.lit(edges[at])
        return F.when(F.col("v") < edge, among(first, at)).when(F.col("v") > edge, among(at + 1, end)).otherwise(2 * at + 1)

    return among(0, len(edges))


def _counted(rows: DataFrame, edges: list[float]) -> list[Row]:
    """Count, least and greatest value of each filled bin: at most twice as many rows as edges."""
    bins = rows.groupBy(_bins(edges).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return sorted(bins.collect())


def value_at_rank(rows: DataFrame, rank: int, n: int, bins: int = BINS, left: int = LEFT) -> tuple[float, int]:
    """The value of the 0-based ``rank`` among the ``n`` values of ``rows`` (v double, no null, no NaN), and its last rank.

    Each pass cuts what is left at quantiles of a sketch and counts the bins exactly, so that errors of the sketch cost
    a pass at worst. An edge is a bin of its own: a value that many rows share is found as such, and a bin that lies
    between edges holds neither the least nor the greatest value left, so every pass gets further.
    At most ``left`` values reach the driver, as counts.
    """
    before, lo, hi, now = 0, None, None, n
    while True:
        part = rows if lo is None else rows.filter(F.col("v").between(lo, hi))
        if now <= left:
            for v, c in part.groupBy("v").agg(F.count("*").alias("c")).orderBy("v").collect():
                before += c
                if rank < before:
                    return v, before - 1
        asked = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        sketch = part.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.kll_sketch_agg_double("v", max(8, 8 * bins)).alias("s"))
        row = sketch.select("lo", "hi", F.kll_sketch_get_quantile_double("s", asked).alias("q")).first()
        for _, now, lo, hi in _counted(part, sorted({row["lo"], *row["q"], row["hi"]})):
            if rank < before + now:
                break
            before += now
        if lo == hi:
            return lo, before + now - 1


def exact_quantile(rows: DataFrame, value: str, q: float, bins: int = BINS, left: int = LEFT) -> tuple[int, float | None]:
    """(n, quantile with linear interpolation) of the values that are not null or NaN, without a sort of all of them."""
    v = F.col(value).cast("double")
    held = rows.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n = held.count()
    if not n:
        return 0, None
    position = q * (n - 1)
    low, last = value_at_rank(held, int(position), n, bins, left)
    if last > int(position) or position == int(position):
        return n, low
    high = held.filter(F.col("v") > low).agg(F.min("v")).first()[0]
    return n, low + (high - low) * (position - int(position))
