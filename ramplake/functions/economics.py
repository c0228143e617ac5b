"""Settlement accounting as expressions. Energies in MWh, prices per MWh."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from ramplake.functions.clip import at_least


def _positive(value: Column) -> Column:
    return at_least(value, 0.0)


def imbalance_cashflow(actual: Column, scheduled: Column, buy: Column, sell: Column, hours: float = 0.5) -> dict[str, Column]:
    deviation = (actual - scheduled) * hours
    shortfall, surplus = _positive(-deviation) * buy, _positive(deviation) * sell
    return {"deviation_mwh": deviation, "shortfall_purchase": shortfall, "surplus_sale": surplus, "net_imbalance_cost": shortfall - surplus}


def excess_error_energy(actual: Column, scheduled: Column, tolerance: float, hours: float) -> Column:
    return _positive(F.abs(actual - scheduled) - tolerance) * hours


def settlement_opportunity_cost(actual, scheduled, contract, buy, sell, hours: float = 0.5) -> Column:
    """Imbalance cost plus the value of the schedule error at the contract price."""
    net = imbalance_cashflow(actual, scheduled, buy, sell, hours)["net_imbalance_cost"]
    return net + (actual - scheduled) * hours * contract


def complete_revenue(actual, scheduled, forward, buy, sell, hours: float = 0.5) -> Column:
    net = imbalance_cashflow(actual, scheduled, buy, sell, hours)["net_imbalance_cost"]
    return scheduled * forward * hours - net


def two_sided_price(pmp_up: Column, pmp_down: Column, vwap_sign: Column, trend: Column, imbalance_sign: Column, k_up: Column, k_down: Column) -> Column:
    """Settlement price of one interval: the trend picks price and factor, the signs decide plus or minus."""
    legal = vwap_sign.isin("positive", "negative") & trend.isin("up", "down") & imbalance_sign.isin("positive", "negative")
    price, k = F.when(trend == "up", pmp_up).otherwise(pmp_down), F.when(trend == "up", k_up).otherwise(k_down)
    plus = (vwap_sign == "positive") == (imbalance_sign == "negative")
    return F.when(legal, price * F.when(plus, 1 + k).otherwise(1 - k)).otherwise(F.raise_error(F.lit("invalid sign category")).cast("double"))
