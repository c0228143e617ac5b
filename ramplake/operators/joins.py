"""Time-series joins: as-of, interpolation, interval overlap, nearest units, calipers, refit windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ramplake.config import DAY_US, MATURITY_MINUTES, MINUTE_US
from ramplake.functions import geo, paths
from ramplake.operators.chunks import cut_lineage, equal_chunks, running

MAX_CLASS = 62


def coalesce_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi join; columns that both sides carry are merged, the left value first."""
    shared = [c for c in right.columns if c in left.columns and c not in on]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    out = left.join(renamed, on, how)
    return out.withColumns({c: F.coalesce(c, f"_r_{c}") for c in shared}).drop(*[f"_r_{c}" for c in shared]) if shared else out


def day_lagged(left: DataFrame, daily: DataFrame, ts: str, day: str, columns: list[str]) -> DataFrame:
    """A daily feature of day D is visible from D + 1 on."""
    shifted = daily.select(F.date_add(day, 1).alias("_day"), *columns)
    return left.withColumn("_day", F.to_date(ts)).join(shifted, "_day", "left").drop("_day")


def feature_join(left: DataFrame, feature: DataFrame, on: list[str], value: str, prefix: str) -> DataFrame:
    """Left join of a resampled feature with availability and missing flags and a zero fill."""
    f = feature.select(*on, F.col(value).alias("_f"))
    out = left.join(f, on, "left")
    have = F.col("_f").isNotNull()
    return out.withColumns({
        f"{prefix}_value": F.coalesce("_f", F.lit(0.0)), f"{prefix}_available": have.cast("int"), f"{prefix}_missing": (~have).cast("int"),
    }).drop("_f")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], us: str, value: str, tolerance_us: int) -> DataFrame:
    """Value of the nearest right row in time within the tolerance, the earlier one on ties.

    Both sides are stacked and scanned once in each direction, so no pair of rows is ever formed.
    """
    tagged = left.withColumns({"_side": F.lit(1), "_item": F.lit(None).cast(f"struct<t:bigint,v:{dict(right.dtypes)[value]}>")})
    source = right.select(*keys, us, F.lit(0).alias("_side"), F.struct(F.col(us).alias("t"), F.col(value).alias("v")).alias("_item"))
    both = equal_chunks(tagged.unionByName(source, allowMissingColumns=True), keys, us)
    out = running(both, keys, us, {"_before": ("last", F.col("_item"))}, ties=("_side",), chunk="_chunk")
    out = out.withColumn("_side", 1 - F.col("_side"))
    out = running(out, keys, us, {"_after": ("last", F.col("_item"))}, ties=("_side",), chunk="_chunk", reverse=True).filter("_side = 0")
    back, ahead = F.col(us) - F.col("_before.t"), F.col("_after.t") - F.col(us)
    use_before = F.coalesce(back <= ahead, back.isNotNull())
    picked = F.when(use_before, F.col("_before")).otherwise(F.col("_after"))
    out = out.withColumn("_pick", F.when(F.abs(picked["t"] - F.col(us)) <= tolerance_us, picked))
    return out.select(*left.columns, F.col("_pick.t").alias("match_us"), F.col("_pick.v").alias(f"match_{value}"))


def common_events(base: DataFrame, others: list[DataFrame], keys: list[str], us: str, tolerance_us: int) -> DataFrame:
    """Base events that every other detector also found within the tolerance."""
    out = base
    for other in others:
        found = asof_nearest(out, other.withColumn("_hit", F.lit(1)), keys, us, "_hit", tolerance_us)
        out = found.filter("match_us IS NOT NULL").select(*base.columns)
    return out


def interpolate_hourly(nodes: DataFrame, hourly: DataFrame, keys: list[str], us: str, columns: list[str], outside: str = "null") -> DataFrame:
    """Value at each node from the bracketing hourly samples; exact hours borrow nothing.

    A node without both samples is null, or takes the one that exists with ``outside='clamp'``.
    """
    hour = 60 * MINUTE_US
    floor = F.floor(F.col(us) / hour).cast("long") * hour
    marked = nodes.withColumns({"_lo": floor, "_hi": F.when(F.col(us) == floor, floor).otherwise(floor + hour)})
    low = hourly.select(*keys, F.col(us).alias("_lo"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    high = hourly.select(*keys, F.col(us).alias("_hi"), *[F.col(c).alias(f"_h_{c}") for c in columns])
    out = marked.join(low, [*keys, "_lo"], "left").join(high, [*keys, "_hi"], "left")
    share = (F.col(us) - F.col("_lo")) / hour
    def value(c: str) -> Column:
        line = F.when(share == 0, F.col(f"_l_{c}")).otherwise(F.col(f"_l_{c}") * (1 - share) + F.col(f"_h_{c}") * share)
        return F.coalesce(line, f"_l_{c}", f"_h_{c}") if outside == "clamp" else line
    return out.select(*nodes.columns, *[value(c).alias(c) for c in columns])


def interpolate_irregular(nodes: DataFrame, source: DataFrame, keys: list[str], us: str, value: str, outside: str = "null") -> DataFrame:
    """Linear interpolation in an irregular source through the bracketing samples."""
    tagged = nodes.withColumns({"_side": F.lit(1), "_item": F.lit(None).cast("struct<t:bigint,v:double>")})
    samples = source.select(*keys, us, F.lit(0).alias("_side"), F.struct(F.col(us).alias("t"), F.col(value).cast("double").alias("v")).alias("_item"))
    both = equal_chunks(tagged.unionByName(samples, allowMissingColumns=True), keys, us)
    out = running(both, keys, us, {"_p": ("last", F.col("_item"))}, ties=("_side",), chunk="_chunk")
    out = out.withColumn("_side", 1 - F.col("_side"))
    out = running(out, keys, us, {"_n": ("last", F.col("_item"))}, ties=("_side",), chunk="_chunk", reverse=True).filter("_side = 0")
    p, n = F.col("_p"), F.col("_n")
    line = F.when(p["t"] == n["t"], p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * (F.col(us) - p["t"]) / (n["t"] - p["t"]))
    if outside == "clamp":
        line = F.coalesce(line, p["v"], n["v"])
    return out.select(*nodes.columns, line.alias(value))


def vintage_guard(df: DataFrame, valid_us: Column, issue_us: Column, age_us: int = DAY_US) -> DataFrame:
    """Rows whose forecast was already out at issue, plus the audit of the margin in hours."""
    margin = (issue_us - (valid_us - age_us)) / (60 * MINUTE_US)
    return df.withColumn("margin_hours", margin).withColumn("accepted", margin > 0)


def _size_class(length: Column) -> Column:
    """Smallest k with length <= 2^k."""
    return F.greatest(F.ceil(F.log2(length.cast("double"))), F.lit(0)).cast("int")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], min_ratio: float | None = None) -> DataFrame:
    """Pairs with positive overlap of ``[start, end)`` intervals, found by equi joins.

    Intervals fall into classes by powers of two of their length. The longer one of a pair is filed under the
    cells of its own class; the shorter one looks into the cells of every class at least its own. So one very long
    interval never widens the search of the short ones. With ``min_ratio`` (shorter / longer length) only the
    classes that can qualify are visited. Columns: keys, a_id, a_start, a_end, b_id, b_start, b_end.
    """
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("id", "start", "end")])
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("id", "start", "end")])
    a = a.withColumn("_ca", _size_class(F.col("a_end") - F.col("a_start")))
    b = b.withColumn("_cb", _size_class(F.col("b_end") - F.col("b_start")))
    reach = None if min_ratio is None else math.ceil(math.log2(1 / min_ratio)) + 1

    def seek(df: DataFrame, p: str, own: str, top: Column, strict: bool) -> DataFrame:
        first = F.col(own) + (1 if strict else 0)
        last = top if reach is None else F.least(top, F.col(own) + reach)
        out = df.withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
        width = F.pow(F.lit(2.0), F.col("_k"))
        low, high = F.floor(F.col(f"{p}_start") / width), F.floor((F.col(f"{p}_end") - 1) / width)
        return out.withColumn("_cell", F.explode(F.sequence(low, high)))

    def file(df: DataFrame, p: str, own: str) -> DataFrame:
        width = F.pow(F.lit(2.0), F.col(own))
        low, high = F.floor(F.col(f"{p}_start") / width), F.floor((F.col(f"{p}_end") - 1) / width)
        return df.withColumn("_k", F.col(own)).withColumn("_cell", F.explode(F.sequence(low, high)))

    top_a, top_b = a.agg(F.max("_ca")).scalar(), b.agg(F.max("_cb")).scalar()
    on = [*keys, "_k", "_cell"]
    short_a = seek(a, "a", "_ca", top_b, False).join(file(b, "b", "_cb"), on)
    short_b = seek(b, "b", "_cb", top_a, True).join(file(a, "a", "_ca"), on)
    cols = [*keys, "a_id", "a_start", "a_end", "b_id", "b_start", "b_end", "_k", "_cell"]
    pairs = short_a.select(*cols).unionByName(short_b.select(*cols))
    home = F.floor(F.greatest("a_start", "b_start") / F.pow(F.lit(2.0), F.col("_k")))
    overlap = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return pairs.filter((overlap > 0) & (F.col("_cell") == home)).drop("_k", "_cell").withColumn("overlap", overlap)


def overlap_scores(left: DataFrame, right: DataFrame, keys: list[str], cutoff: float, measure: str = "iou") -> DataFrame:
    """Qualifying pairs by overlap over the union (``iou``) or over the shorter length (``containment``)."""
    if measure not in ("iou", "containment") or not 0 < cutoff <= 1:
        raise ValueError("invalid overlap definition")
    pairs = overlapping(left, right, keys, cutoff if measure == "iou" else None)
    len_a, len_b = F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")
    iou = F.col("overlap") / (len_a + len_b - F.col("overlap"))
    score = iou if measure == "iou" else F.col("overlap") / F.least(len_a, len_b)
    return pairs.withColumns({"iou": iou, "score": score}).filter(F.col("score") >= cutoff)


def window_event_counts(windows: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Events fully inside (closed) and events overlapping (open) each window, with a priority label."""
    pairs = overlapping(windows, events, keys)
    inside = (F.col("b_start") >= F.col("a_start")) & (F.col("b_end") <= F.col("a_end"))
    counts = pairs.groupBy(*keys, F.col("a_id").alias("id")).agg(F.count_if(inside).alias("n_inside"), F.count("*").alias("n_overlap"))
    out = windows.join(counts, [*keys, "id"], "left").fillna(0, ["n_inside", "n_overlap"])
    label = F.when(F.col("n_inside") > 0, "complete").when(F.col("n_overlap") > 0, "partial").otherwise("none")
    return out.withColumn("relation", label)


def nearest_units(units: DataFrame, k: int, metric: str = "haversine") -> DataFrame:
    """k nearest other units (id, lat, lon) with distance and rank; ties by id.

    A unit meets the 3x3 block of grid cells around it. What lies outside is at least one cell away, so its list is
    final when the k-th distance is below that; the other units try again with cells of twice the size. The last
    round, where one block covers the whole extent, is complete by itself.
    """
    size = units.agg(F.count("*").alias("n"), F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")).alias("extent")).first()
    extent = max(size["extent"] or 0.0, 1e-9)
    cell = extent / max(1.0, math.sqrt(size["n"] / (k + 1)))
    a = units.select(F.col("id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = units.select(F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    planar = metric == "planar"
    dist = F.hypot(F.col("lat1") - F.col("lat2"), F.col("lon1") - F.col("lon2")) if planar else geo.haversine_m("lat1", "lon1", "lat2", "lon2")
    nearest, found = W.partitionBy("src").orderBy("distance_m", "dst"), None
    while True:
        near = F.sequence(F.lit(-1), F.lit(1))
        left = a.withColumn("_i", F.explode(F.transform(near, lambda d: F.floor(F.col("lat1") / cell) + d)))
        # on the globe columns are whole parts of the circle, and the last one lies beside the first
        around = 0 if planar else max(1, int(360 // cell))
        wide = cell if planar else 360 / around
        column = lambda lon, d: F.floor(F.col(lon) / wide) + d if planar else F.pmod(F.floor((F.col(lon) + 180) / wide) + d, F.lit(around))
        left = left.withColumn("_j", F.explode(F.array_distinct(F.transform(near, lambda d: column("lon1", d)))))
        right = b.withColumns({"_i": F.floor(F.col("lat2") / cell), "_j": column("lon2", F.lit(0))})
        pairs = left.join(right, ["_i", "_j"]).drop("_i", "_j").filter("src <> dst").withColumn("distance_m", dist)
        ranked = cut_lineage(pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k))
        if cell >= extent:
            return ranked if found is None else found.unionByName(ranked)
        # smallest possible distance to a point outside the block
        reach = F.lit(cell) if planar else 2 * geo.EARTH_RADIUS_M * F.asin(
            F.cos(F.radians(F.least(F.abs("lat1") + cell, F.lit(90.0)))) * F.sin(F.radians(F.lit(cell)) / 2))
        final = ranked.groupBy("src").agg(F.count("*").alias("_n"), F.max("distance_m").alias("_far"), F.first(reach).alias("_reach"))
        final = final.filter((F.col("_n") == k) & (F.col("_far") < F.col("_reach"))).select("src")
        part = ranked.join(final, "src", "left_semi").select(ranked.columns)
        found = part if found is None else found.unionByName(part)
        a = cut_lineage(a.join(final, "src", "left_anti"))
        if a.isEmpty():
            return found
        cell *= 2


def enrich_edges(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Bearing, elevation difference, roughness pair and wake prior of the edge list."""
    side = lambda p, i: units.select(F.col("id").alias(p), F.col("elev").alias(f"_e{i}"), F.greatest(F.coalesce("z0", F.lit(0.0)), F.lit(1e-6)).alias(f"_z{i}"))
    out = edges.join(side("src", 1), "src").join(side("dst", 2), "dst")
    return out.withColumns({
        "bearing_rad": geo.bearing_rad("lat1", "lon1", "lat2", "lon2"), "elevation_diff_m": F.col("_e2") - F.col("_e1"),
        "roughness_pair": F.sqrt(F.col("_z1") * F.col("_z2")), "wake_prior": F.exp(-F.col("distance_m") / 1500.0),
    }).drop("_e1", "_e2", "_z1", "_z2")


def caliper_pairs(
    left: DataFrame, right: DataFrame | None, exact: list[str], *, rmse: float = 0.075, gap_us: int = DAY_US,
    hours: float = 3.0, level: float = 0.10, path: str = "path",
) -> DataFrame:
    """Pairs that agree on ``exact`` and lie inside every caliper; ``right=None`` pairs a table with itself.

    Start level, net change and range are cut into cells as wide as the caliper. One side is copied to the
    neighbouring cells, so only rows that can match meet.
    """
    def describe(df: DataFrame, p: str) -> DataFrame:
        x = paths.nodes(path)
        cols = {"start": x[0], "net": x[-1] - x[0], "range": F.array_max(path) - F.array_min(path), "hour": F.pmod(F.col("us") / 3600000000, F.lit(24.0))}
        return df.select(*exact, F.col("id").alias(f"{p}_id"), F.col("us").alias(f"{p}_us"), F.col(path).alias(f"{p}_path"), *[c.alias(f"{p}_{n}") for n, c in cols.items()])
    a, b = describe(left, "a"), describe(left if right is None else right, "b")
    dims = ("start", "net", "range")
    for d in dims:
        cell = F.floor(F.col(f"a_{d}") / level)
        a = a.withColumn(f"_{d}", F.explode(F.array(cell - 1, cell, cell + 1)))
        b = b.withColumn(f"_{d}", F.floor(F.col(f"b_{d}") / level))
    pairs = a.join(b, [*exact, *[f"_{d}" for d in dims]])
    if right is None:
        pairs = pairs.filter("a_id < b_id")
    turn = F.abs(F.col("a_hour") - F.col("b_hour"))
    squares = F.zip_with("a_path", "b_path", lambda u, v: (u - v) * (u - v))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, v: total + v) / F.size("a_path"))
    keep = (F.abs(F.col("a_us") - F.col("b_us")) >= gap_us) & (F.least(turn, 24 - turn) <= hours)
    for d in dims:
        keep = keep & (F.abs(F.col(f"a_{d}") - F.col(f"b_{d}")) <= level)
    return pairs.filter(keep).withColumn("distance", distance).filter(F.col("distance") <= rmse).select(*exact, "a_id", "b_id", "a_us", "b_us", "distance")


def alignment_check(left: DataFrame, right: DataFrame, on: list[str], target: str, tol: float = 1e-3) -> DataFrame:
    """Keys on one side only and targets that disagree, as one row of counts."""
    a = left.select(*on, F.col(target).alias("_a"), F.lit(1).alias("_ia"))
    b = right.select(*on, F.col(target).alias("_b"), F.lit(1).alias("_ib"))
    both = a.join(b, on, "full")
    return both.agg(
        F.count_if(F.col("_ib").isNull()).alias("left_only"), F.count_if(F.col("_ia").isNull()).alias("right_only"),
        F.count_if(F.abs(F.col("_a") - F.col("_b")) > tol).alias("mismatched"), F.count("*").alias("keys"))


def training_rows(rows: DataFrame, us: str, days: int = 56, period_us: int = 7 * DAY_US, offset_us: int = 4 * DAY_US, maturity_minutes: int = MATURITY_MINUTES) -> DataFrame:
    """Every refit update a row can train: start within ``days`` before it and label mature at it.

    Updates lie on a fixed period (Mondays by default), so they follow from the row's own clock by arithmetic.
    """
    mature = F.col(us) + maturity_minutes * MINUTE_US
    first = F.ceil((mature - offset_us) / period_us)
    last = F.floor((F.col(us) + days * DAY_US - offset_us) / period_us)
    steps = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("update_us", F.explode(steps)).withColumn("update_us", F.col("update_us") * period_us + offset_us)
