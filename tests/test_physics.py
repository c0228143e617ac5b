"""Window physics against interpolation and sums in numpy."""

import numpy as np
import pandas as pd

from ramplake.operators.physics import FIELDS, window_physics


def by_numpy(hours, fields, q):
    """One window: fields at 17 nodes by np.interp; the flux by the hour that each quarter's midpoint lies in."""
    nodes = (q + np.arange(17)) / 4
    at = {f: np.interp(nodes, hours, fields[f]) for f in FIELDS if f != "sshf"}
    ends = np.searchsorted(hours, nodes[:-1] + 0.125)
    speed, shear = np.hypot(at["u100"], at["v100"]), np.hypot(at["u100"] - at["u10"], at["v100"] - at["v10"])
    return [
        np.trapezoid(shear, dx=1 / 16), fields["sshf"][ends].mean() / 3600, np.trapezoid(speed, dx=1 / 16), speed[-1] - speed[0],
        np.hypot(at["u100"][-1] - at["u100"][0], at["v100"][-1] - at["v100"][0]), at["t2m"][-1] - at["t2m"][0], (at["sp"][-1] - at["sp"][0]) / 100]


COLUMNS = ["shear", "heat", "speed100", "wind_delta", "vector_delta", "temperature_delta", "pressure_delta_hpa"]


def test_windows_equal_numpy(spark):
    rng = np.random.default_rng(8)
    hours = np.arange(-3, 60)  # hours before the epoch too
    fields = {f: rng.normal(0, 5, len(hours)) for f in FIELDS}
    hourly = spark.createDataFrame(pd.DataFrame({"site": "a", "b": hours, **fields}))
    quarters = list(range(-12, 4 * 55))
    got = window_physics(hourly, spark.createDataFrame([("a", q) for q in quarters], "site string, q long"), ["site"]).orderBy("q").toPandas()
    assert got["q"].tolist() == quarters
    np.testing.assert_allclose(got[COLUMNS].to_numpy(float), [by_numpy(hours, fields, q) for q in quarters], atol=1e-9)


def test_missing_hours_and_fields_give_null(spark):
    rows = [("a", h, *(float(h + k) for k in range(7))) for h in range(12) if h != 6]
    rows[8] = (*rows[8][:8], None)  # the accumulation of hour 9
    hourly = spark.createDataFrame(rows, "site string, b long, " + ", ".join(f"{f} double" for f in FIELDS))
    starts = spark.createDataFrame([("a", q) for q in (0, 8, 9, 20, 27, 28)] + [("b", 0), (None, 0)], "site string, q long")
    got = {(r["site"], r["q"]): r for r in window_physics(hourly, starts, ["site"]).collect()}
    assert len(got) == 8
    assert all(got["a", 0][c] is not None for c in COLUMNS)
    # on the hour only hour 2 to 6 count, and 6 is missing; the flux needs hours 3 to 6
    assert all(got["a", 8][c] is None for c in COLUMNS) and all(got["a", 9][c] is None for c in COLUMNS)
    assert got["a", 28]["heat"] is None and got["a", 28]["shear"] is not None
    assert got["a", 20]["temperature_delta"] is not None and got["a", 20]["shear"] is None  # the ends are there, a node between is not
    assert all(got["b", 0][c] is None for c in COLUMNS) and all(got[None, 0][c] is None for c in COLUMNS)
