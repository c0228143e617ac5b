"""Station networks: normalization, geometry, coverage, selection and weighted priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ramplake.config import EARTH_RADIUS_M
from ramplake.functions import geo
from ramplake.operators.chunks import exact_quantiles, windowed
from ramplake.functions.clip import at_least, at_most, clip


def normalize_stations(product: DataFrame, meta: DataFrame, value: str, quality: str | None = None) -> DataFrame:
    """value, quality (one when absent), availability flag, zero for missing values, station metadata."""
    q = F.coalesce(F.col(quality).cast("double"), F.lit(1.0)) if quality else F.lit(1.0)
    have = F.col(value).isNotNull()
    out = product.select("t", "station_id", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"), q.alias("quality"), have.cast("double").alias("available"))
    return out.join(meta, "station_id", "left")


def station_geo(meta: DataFrame, lat: float, lon: float, elev: float = 0.0) -> DataFrame:
    """Distance, both bearings and elevation difference to the farm."""
    a, o = F.lit(lat), F.lit(lon)
    return meta.withColumns({
        "distance_m": geo.haversine_m("lat", "lon", a, o), "to_farm_rad": geo.bearing_rad("lat", "lon", a, o),
        "from_farm_rad": geo.bearing_rad(a, o, F.col("lat"), F.col("lon")), "elevation_diff_m": F.col("elev") - elev,
    })


def coverage(product: DataFrame, meta: DataFrame, times: Column) -> DataFrame:
    """Share of the aligned times at which each station is present; absent combinations count as zero."""
    present = product.filter("available > 0").select("station_id", "t").distinct().groupBy("station_id").agg(F.count("*").alias("_n"))
    return meta.join(present, "station_id", "left").withColumn("coverage", F.coalesce(F.col("_n"), F.lit(0)) / times).drop("_n")


def flow_direction(product: DataFrame) -> DataFrame:
    """Flow direction from the first usable source of the whole table: direction, components, proxy."""
    has = lambda c: product.filter(F.col(c).isNotNull()).limit(1).count() > 0 if c in product.columns else False
    if has("wind_dir_rad"):
        direction = F.col("wind_dir_rad")
    elif has("u100") and has("v100"):
        direction = F.atan2("v100", "u100")
    else:
        direction = F.when(F.col("proxy_available") > 0, F.atan2("proxy_v", "proxy_u"))
    return product.withColumn("flow_rad", direction)


def gradient_direction(product: DataFrame) -> DataFrame:
    """Unit gradient of the least-squares plane through at least three stations per time, from grouped sums."""
    centre = exact_quantiles(product, [], "lat", {"q": 0.5}).select("q").scalar(), exact_quantiles(product, [], "lon", {"q": 0.5}).select("q").scalar()
    data = product.filter((F.col("available") > 0.5) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    data = data.withColumns({"_la": centre[0], "_lo": centre[1]})
    x = EARTH_RADIUS_M * F.cos(F.radians("_la")) * F.radians(F.col("lon") - F.col("_lo"))
    y = EARTH_RADIUS_M * F.radians(F.col("lat") - F.col("_la"))
    # kilometres keep the sums of squares in range
    data = data.select("t", (x / 1000).alias("x"), (y / 1000).alias("y"), F.col("value").alias("z"))
    g = data.groupBy("t").agg(
        F.count("*").alias("n"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("y", "y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
        F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    gx, gy = F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det), F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det)
    size = F.hypot(gx, gy)
    ok = (F.col("n") >= 3) & (F.abs(det) > 1e-9) & (size > 1e-9)
    return g.select("t", F.coalesce(F.when(ok, gx / size), F.lit(0.0)).alias("proxy_u"), F.coalesce(F.when(ok, gy / size), F.lit(0.0)).alias("proxy_v"), F.coalesce(ok, F.lit(False)).cast("double").alias("proxy_available"))


def select_nearest(meta: DataFrame, threshold: float = 0.8, sizes: tuple[int, ...] = (10, 15, 20)) -> DataFrame:
    """The smallest neighbourhood whose mean coverage reaches the threshold, else the largest. ``meta`` has one row per station."""
    ranked = meta.withColumn("rank", F.row_number().over(W.orderBy("distance_m", "station_id")))
    tests = ranked.agg(*[F.avg(F.when(F.col("rank") <= k, F.col("coverage"))).alias(f"c{k}") for k in sizes])
    choice = F.lit(sizes[-1])
    for k in reversed(sizes):
        choice = F.when(F.col(f"c{k}") >= threshold, k).otherwise(choice)
    return ranked.withColumn("k", tests.select(choice.alias("k")).scalar()).filter(F.col("rank") <= F.col("k"))


def upwind_alignment(bearing: Column, flow: Column) -> Column:
    c = at_least(F.cos(bearing - flow), 0.0)
    return F.coalesce(c * c, F.lit(0.0))


def select_upwind(product: DataFrame, meta: DataFrame, times: Column, *, threshold: float = 0.8, fallback: float = 0.05, target: int = 10, minimum: int = 4, sigma_m: float = 350000.0) -> DataFrame:
    """Stations by coverage × alignment × distance weight. Where too few reach the coverage, the fallback applies to all;
    too few then is an error."""
    aligned = product.join(meta.select("station_id", "to_farm_rad"), "station_id")
    per_time = aligned.groupBy("station_id", "t").agg(F.avg(upwind_alignment(F.col("to_farm_rad"), F.col("flow_rad"))).alias("_a"))
    mean = per_time.groupBy("station_id").agg((F.sum("_a") / times).alias("alignment"))
    out = meta.join(mean, "station_id", "left").withColumn("alignment", F.coalesce("alignment", F.lit(0.0)))
    out = out.withColumn("distance_weight", F.exp(-F.col("distance_m") / sigma_m))
    possible = F.col("coverage") * F.col("alignment") * F.col("distance_weight")
    enough = out.agg(F.count_if((F.col("coverage") >= threshold) & (possible > 0)) >= minimum).scalar()
    needed = F.when(enough, F.lit(threshold)).otherwise(F.lit(min(threshold, fallback)))
    score = (F.col("coverage") >= needed).cast("double") * possible
    ranked = out.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), F.desc("coverage"), F.desc("alignment"), "distance_m", "station_id").limit(target)
    found = ranked.agg(F.count("*")).scalar()
    return ranked.filter(F.when(found >= minimum, True).otherwise(F.raise_error(F.lit("too few upwind stations")).cast("boolean")))


def upwind_weights(product: DataFrame, meta: DataFrame, threshold: float = 0.8) -> DataFrame:
    out = product.join(meta.select("station_id", "to_farm_rad", "coverage", "distance_weight"), "station_id", "left")
    align = upwind_alignment(F.col("to_farm_rad"), F.col("flow_rad"))
    weight = F.col("available") * (F.col("coverage") >= threshold).cast("double") * F.col("coverage") * F.col("distance_weight") * align
    return out.withColumns({"upwind_alignment": align, "upwind_weight": weight, "upwind_mask": (weight > 0).cast("double")})


def station_features(product: DataFrame) -> DataFrame:
    """Differences over exactly one and three steps between available values, trailing mean and deviation."""
    def cols(w):
        f = w.rangeBetween(-2, 0)
        out = {}
        for n in (1, 3):
            same = (F.col("t") - F.lag("t", n).over(w) == n) & (F.col("available") > 0) & (F.lag("available", n).over(w) > 0)
            out[f"diff_{n}"] = F.coalesce(F.when(same, F.col("value") - F.lag("value", n).over(w)), F.lit(0.0))
        out["mean_3"] = F.avg("value").over(f)
        out["std_3"] = F.coalesce(F.stddev_pop("value").over(f), F.lit(0.0))
        return out
    return windowed(product, ["station_id"], "t", 3, 0, cols)


def network_prior(product: DataFrame, source: str = "upwind", top_k: int = 3) -> DataFrame:
    """Weighted u, v per time with direction, speed and confidence; sources mean, topk, upwind, physics."""
    data = product.filter("u100 IS NOT NULL AND v100 IS NOT NULL").withColumn("_ok", (F.coalesce("available", F.lit(0.0)) > 0.5).cast("double"))
    data = data.withColumn("_up", at_least(F.coalesce("upwind_weight", F.lit(0.0)), 0.0))
    if source == "topk":
        data = data.withColumn("_r", F.row_number().over(W.partitionBy("t").orderBy(F.desc("_up"), "station_id")))
        raw = F.when(F.col("_r") <= top_k, F.col("_up")).otherwise(0.0)
    else:
        raw = F.lit(1.0) if source == "mean" else F.col("_up")
    data = data.withColumn("_raw", raw)
    all_w = W.partitionBy("t")
    data = data.withColumn("_w", F.when(F.sum("_raw").over(all_w) > 0, F.col("_raw")).otherwise(1.0) * F.col("_ok"))
    aggs = [F.sum("_w").alias("_sw"), F.sum(F.col("u100") * F.col("_w")).alias("_su"), F.sum(F.col("v100") * F.col("_w")).alias("_sv"), F.sum("_ok").alias("_n"), F.count("*").alias("_all"),
            F.sum(F.col("_ok") * (F.col("_up") > 0).cast("double")).alias("_np"), F.coalesce(F.avg(clip(F.col("quality"), 0.0, 1.0)), F.lit(1.0)).alias("_q")]
    if source == "physics":
        data = _signal(data)
        aggs += [F.sum(F.col("_sg") * F.cos("to_farm_rad")).alias("_gu"), F.sum(F.col("_sg") * F.sin("to_farm_rad")).alias("_gv"), F.sum(F.abs("_sg")).alias("_ga")]
    g = data.groupBy("t").agg(*aggs).filter("_sw > 0")
    u, v, extra = F.col("_su") / F.col("_sw"), F.col("_sv") / F.col("_sw"), F.lit(1.0)
    if source == "physics":
        g = g.withColumns({"_u0": u, "_v0": v})
        norm, speed = F.hypot("_gu", "_gv"), F.hypot("_u0", "_v0")
        strength = at_most(norm / at_least(F.col("_ga"), 1e-6), 1.0)
        du, dv = F.col("_gu") / F.greatest(norm, F.lit(1e-6)), F.col("_gv") / F.greatest(norm, F.lit(1e-6))
        agree = F.when(speed > 1e-6, (F.col("_u0") * du + F.col("_v0") * dv) / speed).otherwise(0.0)
        mix = at_most(at_least(0.15 + 0.55 * strength * (0.5 + 0.5 * at_least(agree, 0.0)), 0.15), 0.70)
        mix = F.when(norm > 1e-6, mix).otherwise(0.0)
        target = F.when(speed > 1e-6, speed).otherwise(1.0)
        u, v = (1 - mix) * F.col("_u0") + mix * du * target, (1 - mix) * F.col("_v0") + mix * dv * target
        extra = F.when(norm > 1e-6, 0.6 + 0.4 * strength * (0.5 + 0.5 * at_least(agree, 0.0))).otherwise(0.6)
    ratio, share = F.col("_n") / F.col("_all"), F.col("_np") / F.col("_n")
    confidence = ratio * (0.5 + 0.5 * share) * (0.5 + 0.5 * F.col("_q")) * (0.5 + 0.5 * at_most(F.col("_sw") / F.col("_n"), 1.0)) * extra
    return g.select("t", u.alias("u"), v.alias("v"), F.atan2(v, u).alias("dir_rad"), F.hypot(u, v).alias("speed"), at_most(confidence, 1.0).alias("confidence"), F.col("_n").cast("long").alias("stations"))


def _signal(data: DataFrame) -> DataFrame:
    """Geometry-weighted moisture signal per station from per-time z scores clipped at three."""
    w = W.partitionBy("t")
    def z(c: str) -> Column:
        if c not in data.columns:
            return F.lit(0.0)
        sd, n = F.stddev_pop(c).over(w), F.count(c).over(w)
        score = at_most(at_least((F.col(c) - F.avg(c).over(w)) / sd, -3.0), 3.0)
        return F.coalesce(F.when((n >= 2) & (sd >= 1e-6), score), F.lit(0.0))
    signal = z("value") + 0.45 * (0.7 * z("diff_1") + 0.3 * z("diff_3")) + 0.30 * z("dewpoint") - 0.25 * z("dryness") - 0.15 * z("pressure")
    share = F.try_divide(F.col("_w"), F.max("_w").over(w))
    geom = F.col("_ok") * (0.25 + 0.75 * F.coalesce("distance_weight", F.when(F.count("distance_weight").over(w) > 0, 0.0).otherwise(1.0))) * (0.35 + 0.65 * (0.5 + 0.5 * F.coalesce("upwind_alignment", F.lit(0.0)))) * (0.5 + 0.5 * F.coalesce(share, F.lit(0.0)))
    return data.withColumn("_sg", signal * geom)


def prior_vs_truth(prior: DataFrame, truth: DataFrame, keys: list[str] = []) -> DataFrame:
    """Circular error statistics and correlations of a prior against the truth at the same times."""
    both = prior.join(truth.select(*keys, "t", F.col("u").alias("_u"), F.col("v").alias("_v")), [*keys, "t"])
    both = both.withColumn("err", geo.circular_diff_deg(F.atan2("v", "u"), F.atan2("_v", "_u"))).withColumn("_all", F.lit(0))
    marks = exact_quantiles(both, ["_all", *keys], "err", {"median_deg": 0.5, "p90_deg": 0.9})
    stats = both.groupBy("_all", *keys).agg(F.count("*").alias("n"), F.avg("err").alias("mae_deg"), F.corr("u", "_u").alias("corr_u"), F.corr("v", "_v").alias("corr_v"))
    return stats.join(marks, ["_all", *keys]).drop("_all")


def ridge_fit(train: DataFrame, features: list[str], target: str, alpha: float) -> DataFrame:
    """Ridge coefficients (intercept free) from one pass of moments; the small system is solved once, on one row."""
    import numpy as np
    import pandas as pd

    x = [F.lit(1.0)] + [F.col(f) for f in features]
    n = len(x)
    gram = F.array(*[F.sum(x[i] * x[j]) for i in range(n) for j in range(n)])
    right = F.array(*[F.sum(x[i] * F.col(target)) for i in range(n)])
    moments = train.agg(gram.alias("g"), right.alias("r"))

    def solve(batches):
        for pdf in batches:
            for g, r in zip(pdf["g"], pdf["r"]):
                penalty = np.eye(n) * alpha
                penalty[0, 0] = 0.0
                yield pd.DataFrame({"coef": [np.linalg.solve(np.asarray(g, float).reshape(n, n) + penalty, np.asarray(r, float)).tolist()]})

    return moments.mapInPandas(solve, "coef array<double>")


def ridge_apply(df: DataFrame, fitted: DataFrame, features: list[str], name: str) -> DataFrame:
    out = df.withColumn("_c", fitted.select("coef").scalar())
    value = F.col("_c")[0]
    for i, f in enumerate(features, 1):
        value = value + F.col("_c")[i] * F.col(f)
    return out.withColumn(name, value).drop("_c")
