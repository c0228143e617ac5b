"""Event detection and the event catalogue."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ramplake.config import Protocol
from ramplake.operators.chunks import CHUNK, cut_lineage, equal_chunks, running, windowed, with_halo
from ramplake.operators.sliding import add_trailing_quantiles


def fit_scale(data: DataFrame, keys: list[str], capacity: float | None = None, x: str = "x") -> DataFrame:
    """Scale per key: the given capacity, else the 99.5 % quantile of the valid training values.

    ``percentile`` is exact; a key has one value per calendar bin here, so its buffer is bounded by the time span.
    """
    train = data.filter((F.col("split") == "train") & F.col("ok"))
    if capacity is not None:
        return train.groupBy(*keys).agg(F.lit(float(capacity)).alias("scale"))
    return train.groupBy(*keys).agg(F.percentile(x, 0.995).alias("scale"))


def farm_aggregate(data: DataFrame, unit: str, min_fraction: float = 0.8, keys: list[str] = [], n_units: Column | None = None) -> DataFrame:
    """Mean over units per bin, null where fewer than the wanted share of units is valid."""
    total = n_units if n_units is not None else data.agg(F.countDistinct(unit)).scalar()
    out = data.groupBy(*keys, "b").agg(F.avg("x").alias("_m"), F.count("x").alias("units"))
    return out.withColumn("x", F.when(F.col("units") >= F.ceil(min_fraction * total), F.col("_m"))).drop("_m")


def gap_sessions(df: DataFrame, keys: list[str], us: str, gap_us: int) -> DataFrame:
    """Group rows whose distance to the previous row is at most ``gap_us``; start, end and count per group."""
    out = running(equal_chunks(df, keys, us), keys, us, {"_prev": ("last", F.col(us))}, chunk="_chunk", strict=True)
    fresh = F.when(F.col("_prev").isNull() | (F.col(us) - F.col("_prev") > gap_us), F.col(us))
    out = running(out, keys, us, {"session": ("last", fresh)}, chunk="_chunk")
    return out.groupBy(*keys, "session").agg(F.min(us).alias("start"), F.max(us).alias("end"), F.count("*").alias("n")).drop("session")


def detection_runs(series: DataFrame, keys: list[str], minimum: int = 2) -> DataFrame:
    """Rows of maximal valid runs inside one split, with the run's first and last bin.

    Every detector and the description read these rows, so they are written once to the checkpoint folder.
    """
    from ramplake.operators.timegrid import valid_runs

    same = "split" if "split" in series.columns else None
    runs = valid_runs(series, keys, "ok", same).filter("ok")
    kept = [*keys, *(["split"] if same else []), "b", "x", "run_start", "run_end"]
    return cut_lineage(runs.filter(F.col("run_end") - F.col("run_start") + 1 >= minimum).select(*kept))


def _signed(span: int, move: str, hit: Column, config: str) -> Column:
    return F.when(hit, F.struct(F.lit(config).alias("config"), F.lit(span).alias("span"), F.signum(move).cast("int").alias("sign")))


def moving_hits(runs: DataFrame, keys: list[str], protocol: Protocol, methods: tuple[str, ...]) -> DataFrame:
    """Hits of the threshold, historical-tail and mean-shift detectors, all horizons in one window pass."""
    lags = {m: protocol.steps(m) for m in protocol.horizons_minutes}
    history = protocol.steps(protocol.history_minutes) if "financial_tail" in methods else 0
    top = max(lags.values())

    def moves(w):
        out = {}
        for m, lag in lags.items():
            inside = F.col("b") - lag >= F.col("run_start")
            out[f"_m{m}"] = F.when(inside, F.col("x") - F.lag("x", lag).over(w))
            if "mean_shift" in methods:
                recent = F.avg("x").over(w.rangeBetween(-(lag - 1), 0))
                former = F.avg("x").over(w.rangeBetween(-(2 * lag - 1), -lag))
                out[f"_s{m}"] = F.when(F.col("b") - (2 * lag - 1) >= F.col("run_start"), recent - former)
        return out

    data = with_halo(runs, "b", history + 2 * top, 0, max(CHUNK, 8 * (history + 2 * top)))
    data = data.withColumns(moves(W.partitionBy(*keys, "_chunk").orderBy("b")))
    if history:
        q = protocol.tail_probability
        data = add_trailing_quantiles(data, keys, "b", {f"_q{m}": f"_m{m}" for m in lags}, history, [q, 1 - q])
        # a history may not reach into the run before
        data = data.withColumns({f"_q{m}": F.when(F.col("b") - history - lag >= F.col("run_start"), F.col(f"_q{m}")) for m, lag in lags.items()})
    data = data.filter("_own").drop("_chunk", "_own")
    found = []
    for m, lag in lags.items():
        move, shift = F.col(f"_m{m}"), f"_s{m}"
        if "threshold" in methods:
            found.append(_signed(lag, f"_m{m}", F.abs(move) >= protocol.amplitude, f"threshold_{m}min"))
        if "financial_tail" in methods:
            q = F.col(f"_q{m}")
            hit = ((move < q[0]) | (move > q[1])) & (F.abs(move) >= protocol.tail_minimum_amplitude)
            found.append(_signed(lag, f"_m{m}", hit, f"financial_tail_{m}min"))
        if "mean_shift" in methods:
            found.append(_signed(2 * lag - 1, shift, F.abs(shift) >= protocol.amplitude, f"mean_shift_{m}min"))
    kept = [c for c in runs.columns if c != "x"]
    hits = data.select(*kept, F.explode(F.array_compact(F.array(*found))).alias("_h"))
    return hits.select(*kept, F.col("_h.config"), (F.col("b") - F.col("_h.span")).alias("a"), F.col("b").alias("e"), F.col("_h.sign")).drop("b")


def merge_signed(hits: DataFrame, keys: list[str], longest_span: int) -> DataFrame:
    """Merge neighbours of one sign that touch or overlap; a hit of the other sign in between breaks the chain.

    All hits of a config span the same number of bins, so the previous hit decides, and it matters only within
    that span.
    """
    group = [*keys, "run_start", "config"]
    def fresh(w):
        joined = (F.lag("sign", 1).over(w) == F.col("sign")) & (F.col("a") <= F.lag("e", 1).over(w))
        return {"_new": F.when(~F.coalesce(joined, F.lit(False)), F.col("e"))}
    out = windowed(hits, group, "e", longest_span, 0, fresh)
    out = running(out, group, "e", {"_g": ("last", F.col("_new"))})
    rest = [c for c in ("split", "run_end") if c in hits.columns]
    return out.groupBy(*group, *rest, "_g", "sign").agg(F.min("a").alias("a"), F.max("e").alias("e")).drop("_g")


def segment_events(segments: DataFrame, config: str, amplitude: float) -> DataFrame:
    """Segments whose end-to-end change reaches the amplitude, as signed intervals."""
    change = F.col("x_end") - F.col("x_start")
    out = segments.filter(F.abs(change) >= amplitude).withColumn("sign", F.signum(change).cast("int")).withColumn("config", F.lit(config))
    return out.withColumnsRenamed({"start": "a", "end": "e"})


def detect(runs: DataFrame, keys: list[str], protocol: Protocol, configurations: list[str] | None = None) -> DataFrame:
    """Signed intervals of every wanted configuration: keys, split, run bounds, config, a, e, sign, epsilon, history."""
    from ramplake.operators import folds

    wanted = lambda name: configurations is None or name in configurations
    spans = {m: protocol.steps(m) for m in protocol.horizons_minutes}
    methods = tuple(k for k in ("threshold", "financial_tail", "mean_shift") if any(wanted(f"{k}_{m}min") for m in spans))
    shared = [*keys, *(["split"] if "split" in runs.columns else []), "run_start", "run_end"]
    nothing = {"epsilon": F.lit(None).cast("double"), "history_n": F.lit(None).cast("int"), "history_mode": F.lit("not_adaptive")}
    cols = [*shared, "config", "a", "e", "sign", *nothing]
    parts = []
    if methods:
        merged = merge_signed(moving_hits(runs, keys, protocol, methods), keys, 2 * max(spans.values()) - 1)
        merged = merged.withColumns(nothing)
        parts.append(merged if configurations is None else merged.filter(F.col("config").isin(configurations)))
    for eps in protocol.corridor_widths:
        name = f"endpoint_corridor_{eps:.3f}"
        if wanted(name):
            seg = folds.fold_segments(runs, keys, "corridor", epsilon=eps)
            parts.append(segment_events(seg, name, protocol.amplitude))
    eps = protocol.literature_epsilon
    needs_knots = [m for m in spans if wanted(f"opsda_cui2015_{m}min_{eps:.3f}")]
    if wanted(f"sda_florita2013_{eps:.3f}") or needs_knots:
        seg = folds.fold_segments(runs, keys, "swing", epsilon=eps)
        if wanted(f"sda_florita2013_{eps:.3f}"):
            parts.append(segment_events(seg, f"sda_florita2013_{eps:.3f}", protocol.amplitude))
        for m in needs_knots:
            best = folds.optimized_swings(runs, seg, keys, spans[m], protocol.amplitude)
            parts.append(best.withColumns({**nothing, "epsilon": F.lit(eps), "config": F.lit(f"opsda_cui2015_{m}min_{eps:.3f}")}))
    if wanted("adaptive_corridor"):
        seg = folds.fold_segments(runs, keys, "adaptive", history=protocol.steps(protocol.history_minutes))
        parts.append(segment_events(seg, "adaptive_corridor", protocol.amplitude))
    out = parts[0].select(*cols)
    for part in parts[1:]:
        out = out.unionByName(part.select(*cols))
    return out


def describe(events: DataFrame, runs: DataFrame, keys: list[str], protocol: Protocol) -> DataFrame:
    """Amplitude, variation, rates, curvature, chord residual, context and the 25-point shape of each interval.

    The interval and its context are exploded to bins and met with the series by an equi join; one aggregation
    gives every descriptor. The shape is 25 sums with triangular weights, which is linear interpolation.
    """
    minutes, ctx = protocol.resolution_minutes, protocol.steps(protocol.context_minutes)
    steps = lambda w: {
        "_d1": F.when(F.col("b") - 1 >= F.col("run_start"), F.col("x") - F.lag("x", 1).over(w)),
        "_d2": F.when(F.col("b") - 2 >= F.col("run_start"), F.col("x") - 2 * F.lag("x", 1).over(w) + F.lag("x", 2).over(w)),
    }
    lines = windowed(runs, keys, "b", 2, 0, steps).select(*keys, "b", "x", "_d1", "_d2")
    ident = [*keys, "run_start", "run_end", "config", "a", "e"]
    at = lambda name, pos: lines.select(*keys, F.col("b").alias(pos), F.col("x").alias(name))
    base = events.select(*ident).distinct().join(at("_xa", "a"), [*keys, "a"]).join(at("_xe", "e"), [*keys, "e"])
    span = F.sequence(F.greatest(F.col("a") - ctx, F.col("run_start")), F.least(F.col("e") + ctx, F.col("run_end")))
    rows = base.withColumn("b", F.explode(span)).join(lines, [*keys, "b"])
    b, x, a, e = F.col("b"), F.col("x"), F.col("a"), F.col("e")
    inside, after = (b >= a) & (b <= e), (b > a) & (b <= e)
    chord = F.abs(x - (F.col("_xa") + (F.col("_xe") - F.col("_xa")) * (b - a) / (e - a)))
    spots = [a - ctx + ctx * 0.25 * k for k in range(4)] + [a + (e - a) * (k / 16) for k in range(17)] + [e + ctx * 0.25 * (k + 1) for k in range(4)]
    shape = F.array(*[F.sum(x * F.greatest(1 - F.abs(b - p), F.lit(0.0))) for p in spots])
    out = rows.groupBy(*ident, "_xa", "_xe").agg(
        F.max(F.when(inside, x)).alias("_hi"), F.min(F.when(inside, x)).alias("_lo"),
        F.sum(F.when(after, F.abs("_d1"))).alias("total_variation"), F.max(F.when(after, F.abs("_d1"))).alias("_rate"),
        F.sum(F.when((b >= a + 2) & (b <= e), F.abs("_d2"))).alias("_curve"), F.max(F.when(inside, chord)).alias("max_abs_chord_residual"),
        F.avg(F.when(b < a, x)).alias("_pre"), F.avg(F.when(b > e, x)).alias("_post"),
        F.min_by("b", F.when(inside, F.struct("x", "b"))).alias("b_min"), F.max_by("b", F.when(inside, F.struct("x", -b))).alias("b_max"),
        shape.alias("_path"))
    whole = (a - ctx >= F.col("run_start")) & (e + ctx <= F.col("run_end"))
    path = F.transform("_path", lambda v: v - F.col("_xa"))
    norm = F.array_max(F.transform(path, lambda v: F.abs(v)))
    good = whole & (norm > 0)
    out = out.withColumns({
        "duration_hours": (e - a) * minutes / 60, "amplitude": F.col("_xe") - F.col("_xa"), "direction": F.signum(F.col("_xe") - F.col("_xa")).cast("int"),
        "power_start": F.col("_xa"), "power_end": F.col("_xe"), "power_range": F.col("_hi") - F.col("_lo"),
        "max_abs_rate_per_hour": F.col("_rate") * 60 / minutes, "curvature_l1": F.coalesce("_curve", F.lit(0.0)),
        "pre_mean": F.when(whole, F.col("_pre")), "post_mean": F.when(whole, F.col("_post")), "context_complete": whole,
        "representation_eligible": good, "left_boundary": a == F.col("run_start"), "right_boundary": e == F.col("run_end"),
        "shape_normalizer": F.when(good, norm), "shape": F.when(good, F.transform(path, lambda v: (v / norm).cast("float"))),
    })
    return out.drop("_xa", "_xe", "_hi", "_lo", "_rate", "_curve", "_pre", "_post", "_path")


def composites(events: DataFrame, runs: DataFrame, keys: list[str], protocol: Protocol) -> DataFrame:
    """Adjacent ramps of opposite sign with an interior turning point, both legs at least half the amplitude."""
    longest = protocol.composite_max_minutes // protocol.resolution_minutes
    gap = protocol.composite_gap_minutes // protocol.resolution_minutes
    group = [*keys, "run_start", "config"]
    ahead = lambda w: {"_c": F.lead("a", 1).over(w), "_d": F.lead("e", 1).over(w), "_other": F.lead("sign", 1).over(w)}
    pairs = windowed(events, group, "a", 0, longest, ahead, ties=("e",))
    pairs = pairs.filter(
        (F.col("sign") * F.col("_other") < 0) & (F.col("_d") > F.col("e")) & (F.col("_c") - F.col("e") <= gap) & (F.col("_d") - F.col("a") <= longest))
    rest = [c for c in ("split", "run_end") if c in events.columns]
    bins = pairs.select(*group, *rest, "a", "e", "sign", "_c", "_d", F.explode(F.sequence("a", "_d")).alias("b")).join(runs.select(*keys, "b", "x"), [*keys, "b"])
    rise = F.col("sign") > 0
    key = F.struct(F.when(rise, F.col("x")).otherwise(-F.col("x")), -F.col("b"))
    at = lambda pos: F.max(F.when(F.col("b") == F.col(pos), F.col("x")))
    turned = bins.groupBy(*group, *rest, "a", "e", "sign", "_c", "_d").agg(
        F.max_by("b", key).alias("turning"), F.max_by("x", key).alias("_xt"), at("a").alias("_xa"), at("_d").alias("_xd"))
    leg = F.least(F.abs(F.col("_xt") - F.col("_xa")), F.abs(F.col("_xd") - F.col("_xt")))
    turned = turned.filter((F.col("turning") > F.col("a")) & (F.col("turning") < F.col("_d")) & (leg >= protocol.amplitude / 2))
    first = turned.groupBy(*group, *rest, "a", "_d", "turning").agg(F.min_by(F.struct("e", "sign", "_c", "_xa", "_xd"), F.struct("e", "_c")).alias("f"))
    return first.select(
        *group, *rest, "a", F.col("_d").alias("e"), "turning", F.when(F.col("f.sign") > 0, "inverted_v").otherwise("v").alias("event_kind"),
        F.signum(F.col("f._xd") - F.col("f._xa")).cast("int").alias("sign"), F.col("f.e").alias("first_end"), F.col("f._c").alias("second_start"), F.col("f.sign").alias("first_sign"))


def build_catalog(
    series: DataFrame, keys: list[str], protocol: Protocol, *, site: str, configurations: list[str] | None = None, include_composites: bool = True, calibration: str = "training_q995",
) -> DataFrame:
    """One row per primitive or composite event with lineage, descriptors and shape."""
    runs = detection_runs(series, keys)
    events = cut_lineage(detect(runs, keys, protocol, configurations))
    head = F.concat_ws(":", F.lit(site), *keys, F.lit(protocol.protocol_id), F.lit(calibration), "split", "config")
    name = lambda level, kind, a, e: F.concat_ws(":", head, F.lit(level), kind, a, e)
    kind = lambda sign: F.when(sign > 0, "rise").otherwise("fall")
    primitive = events.withColumns({
        "event_level": F.lit("primitive"), "event_kind": kind(F.col("sign")), "turning_index": F.lit(None).cast("long"), "child_event_ids": F.array().cast("array<string>")})
    table = primitive
    if include_composites:
        both = composites(events, runs, keys, protocol).withColumns({
            "event_level": F.lit("composite"), "turning_index": F.col("turning"), "epsilon": F.lit(None).cast("double"), "history_n": F.lit(None).cast("int"), "history_mode": F.lit("not_adaptive"),
            "child_event_ids": F.array(name("primitive", kind(F.col("first_sign")), F.col("a"), F.col("first_end")), name("primitive", kind(-F.col("first_sign")), F.col("second_start"), F.col("e")))})
        table = primitive.unionByName(both.select(*primitive.columns))
    ident = [*keys, "run_start", "run_end", "config", "a", "e"]
    out = table.join(describe(table.select(*ident), runs, keys, protocol), ident)
    return out.withColumns({
        "site": F.lit(site), "event_id": name_of(head), "quality_flag": F.when(F.col("representation_eligible"), "complete_context").otherwise("context_or_run_boundary"),
        "protocol_id": F.lit(protocol.protocol_id), "resolution_minutes": F.lit(protocol.resolution_minutes),
    }).withColumnsRenamed({"sign": "detector_direction"})


def name_of(head: Column) -> Column:
    return F.concat_ws(":", head, "event_level", "event_kind", "a", "e")


def catalog_audit(series: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, valid rows, clock span, candidates and complete shapes per key."""
    rows = series.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if("ok").alias("valid_rows"), F.min("b").alias("first_b"), F.max("b").alias("last_b"))
    found = catalog.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count("shape").alias("complete_shapes"))
    return rows.join(found, keys, "left").fillna(0, ["candidates", "complete_shapes"])


def event_supports(anchors: DataFrame, keys: list[str], us: str, method: str, gap_us: int, pad_us: int) -> DataFrame:
    """Anchors closer than the gap form one support, padded on both sides, with its distinct methods."""
    points = anchors.groupBy(*keys, us).agg(F.collect_set(method).alias("_m"), F.count("*").alias("_n"))
    out = running(equal_chunks(points, keys, us), keys, us, {"_prev": ("last", F.col(us))}, chunk="_chunk", strict=True)
    fresh = F.when(F.col("_prev").isNull() | (F.col(us) - F.col("_prev") > gap_us), F.col(us))
    out = running(out, keys, us, {"_s": ("last", fresh)}, chunk="_chunk")
    names = out.select(*keys, "_s", F.explode("_m").alias("_m")).groupBy(*keys, "_s").agg(F.array_join(F.sort_array(F.collect_set("_m")), ";").alias("methods"))
    spans = out.groupBy(*keys, "_s").agg((F.min(us) - pad_us).alias("start"), (F.max(us) + pad_us).alias("end"), F.sum("_n").alias("anchor_count"))
    return spans.join(names, [*keys, "_s"]).drop("_s")


def support_components(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Number of disjoint unions of intervals per key; touching intervals join."""
    placed = equal_chunks(intervals, keys, "start")
    out = running(placed, keys, "start", {"_reach": ("max", F.col("end"))}, ties=("end",), chunk="_chunk", strict=True)
    return out.groupBy(*keys).agg(F.count_if(F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))).alias("components"))


def lifecycle_vectors(events: DataFrame, series: DataFrame, keys: list[str], before: int = 4, after: int = 4, middle: int = 9) -> DataFrame:
    """Normalized pre / transition / post vector, its total variation and number of direction changes."""
    ident = [*keys, "a", "e"]
    rows = events.select(*ident).distinct().withColumn("b", F.explode(F.sequence(F.col("a") - before, F.col("e") + after)))
    rows = rows.join(series.select(*keys, "b", "x"), [*keys, "b"], "left")
    b, x, a, e = F.col("b"), F.col("x"), F.col("a"), F.col("e")
    spots = [a - before + k for k in range(before)] + [a + (e - a) * (k / (middle - 1)) for k in range(middle)] + [e + k + 1 for k in range(after)]
    out = rows.groupBy(*ident).agg(
        F.count_if(x.isNull()).alias("_gaps"), F.array(*[F.sum(x * F.greatest(1 - F.abs(b - p), F.lit(0.0))) for p in spots]).alias("_w"))
    out = out.filter("_gaps = 0")
    moved = F.transform("_w", lambda v: v - F.col("_w")[0])
    top = F.array_max(F.transform(moved, lambda v: F.abs(v)))
    out = out.withColumn("vector", F.transform(moved, lambda v: v / F.when(top > 0, top).otherwise(1.0)))
    n = before + middle + after
    steps = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("vector", i) - F.get("vector", i - 1))
    out = out.withColumn("_d", steps)
    turns = F.size(F.filter(F.sequence(F.lit(1), F.lit(n - 2)), lambda i: F.signum(F.get("_d", i)) != F.signum(F.get("_d", i - 1))))
    variation = F.aggregate("_d", F.lit(0.0), lambda t, v: t + F.abs(v))
    return out.withColumns({"total_variation": variation, "reversals": turns}).drop("_gaps", "_w", "_d")


def screens(series: DataFrame, keys: list[str], reach: int = 2) -> DataFrame:
    """Steady, rising, falling, turning and any-value strata of centred windows, one row per (bin, stratum)."""
    def cols(w):
        f = w.rangeBetween(-reach, reach)
        full = F.count("x").over(f) == 2 * reach + 1
        return {
            "_spread": F.when(full, F.max("x").over(f) - F.min("x").over(f)), "_level": F.when(full, F.avg("x").over(f)),
            "_net": F.lead("x", reach).over(w) - F.lag("x", reach).over(w),
        }
    data = windowed(series, keys, "b", reach, reach, cols)
    spread, net = F.col("_spread"), F.col("_net")
    strata = {
        "steady": (spread <= 0.04) & (F.col("_level") > 0.1), "rising": net >= 0.20, "falling": net <= -0.20,
        "turning": (spread >= 0.20) & (F.abs(net) <= 0.35 * spread), "random": F.col("x").isNotNull(),
    }
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in strata.items()]))
    return data.select(*keys, "b", F.explode(tags).alias("stratum"))


def spaced_sample(candidates: DataFrame, keys: list[str], quotas: dict[str, int], spacing: int, seed: int = 41) -> DataFrame:
    """Quota sample per stratum in hash order; picks of one key lie at least ``spacing`` bins apart.

    Stratum after stratum, a candidate whose hash is the smallest within its own spacing is picked and its
    neighbours leave; repeated to the end this gives exactly the sequential result, without a sequential scan.
    """
    used = None
    order = F.md5(F.concat_ws("-", F.lit(seed), *keys, "stratum", "b"))
    for stratum, quota in quotas.items():
        open_rows = candidates.filter(F.col("stratum") == stratum).select(*keys, "b", "stratum").withColumn("_h", order)
        if used is not None:
            open_rows = _away_from(open_rows, used, keys, spacing)
        open_rows = cut_lineage(open_rows)
        picked = None
        while True:
            # a pick can only ever come from the local minima; stop as soon as nothing is left
            lowest = windowed(open_rows, keys, "b", spacing - 1, spacing - 1, lambda w: {"_min": F.min(F.struct("_h", "b")).over(w.rangeBetween(-(spacing - 1), spacing - 1))})
            fresh = lowest.filter(F.col("_min.b") == F.col("b")).drop("_min")
            fresh = cut_lineage(fresh)
            if fresh.isEmpty():
                break
            picked = fresh if picked is None else picked.unionByName(fresh)
            open_rows = cut_lineage(_away_from(open_rows, fresh, keys, spacing))
        if picked is None:
            continue
        chosen = cut_lineage(picked.orderBy("_h", "b").limit(quota))
        used = chosen if used is None else used.unionByName(chosen)
    return used.drop("_h")


def _away_from(rows: DataFrame, used: DataFrame, keys: list[str], spacing: int) -> DataFrame:
    blocked = used.select(*keys, F.explode(F.sequence(F.col("b") - (spacing - 1), F.col("b") + spacing - 1)).alias("b")).distinct()
    return rows.join(blocked, [*keys, "b"], "left_anti")


def population_group(n_composite_inside: str, n_primitive_inside: str, n_overlap: str) -> Column:
    """complete composite, else complete primitive, else partial, else none."""
    return F.when(F.col(n_composite_inside) > 0, "complete_composite").when(F.col(n_primitive_inside) > 0, "complete_primitive").when(F.col(n_overlap) > 0, "partial_only").otherwise("none")
