"""Cost of congestion on a link, as one closed-form column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: share of vehicles, occupants, dollars per person-hour, freight dollars per vehicle-hour
DELAY = {
    "Private Car": (50.03, 1.6, 14.99, 0),
    "Business Car": (30.66, 1.4, 48.63, 0),
    "Courier Van-Utility": (15.68, 1.0, 25.41, 0),
    "4WD Mid Size Petrol": (0, 1.5, 25.41, 0),
    "Light Rigid": (0.89, 1.3, 25.41, 1.53),
    "Medium Rigid": (0.83, 1.3, 25.72, 4.15),
    "Heavy Rigid": (0.70, 1.0, 26.19, 14.20),
    "Heavy Bus (driver)": (0.42, 1.0, 25.72, 0),
    "Heavy Bus (passenger)": (0.42, 20.0, 14.99, 0),
    "Artic 4 Axle": (0.05, 1.0, 26.81, 30.59),
    "Artic 5 Axle": (0.05, 1.0, 26.81, 39.01),
    "Artic 6 Axle": (0.05, 1.0, 26.81, 42.06),
    "Rigid and 5 Axle Dog": (0.05, 1.0, 27.20, 62.99),
    "B-Double": (0.21, 1.0, 27.20, 64.91),
    "Twin steer and 5 Axle Dog": (0.38, 1.0, 27.20, 60.89),
}
# fixed values: share of vehicles, then A and B of A + B/v, then C0, C1 and C2 of C0 + C1 v + C2 v^2, in cents per km
OPERATION = {
    "Small Car": (26.9, 12.5242, 838.2969, 25.7952, -0.1253, 0.0010),
    "Medium Car": (26.9, 12.6514, 1315.5178, 35.0470, -0.1751, 0.0012),
    "Large Car": (26.9, 14.4297, 1838.4754, 46.1765, -0.2221, 0.0014),
    "Courier Van-Utility": (15.68, 15.9354, 1357.1233, 38.4920, -0.1840, 0.0014),
    "Light Rigid": (0.89, 33.9697, 1543.5546, 51.5092, -0.2481, 0.0025),
    "Medium Rigid": (0.83, 35.8038, 2259.9048, 62.6793, -0.3002, 0.0026),
    "Heavy Rigid": (0.70, 57.1600, 2556.0769, 82.2900, -0.5525, 0.0053),
    "Heavy Bus": (0.42, 64.5569, 4632.1535, 124.7014, -0.6467, 0.0047),
    "Artic 4 Axle": (0.05, 84.5711, 3323.0102, 111.6621, -0.7240, 0.0072),
    "Artic 5 Axle": (0.05, 91.1303, 3688.6095, 119.8994, -0.6800, 0.0066),
    "Artic 6 Axle": (0.05, 98.6903, 3991.2764, 128.6879, -0.6878, 0.0066),
    "Rigid and 5 Axle Dog": (0.05, 122.5511, 3729.8458, 136.1620, -0.6403, 0.0065),
    "B-Double": (0.21, 122.9920, 4592.1836, 151.4716, -0.7228, 0.0068),
    "Twin steer and 5 Axle Dog": (0.38, 127.1973, 4379.9716, 149.9310, -0.6911, 0.0067),
}
PASSENGER = ("Small Car", "Medium Car", "Large Car", "4WD Mid Size Petrol")
DELAY_INFLATION, PASSENGER_INFLATION, COMMERCIAL_INFLATION = 1.253, 1.242, 1.176
PERIOD_S, SWITCH_KMH = 300.0, 60.0


def _folded() -> tuple[float, tuple[float, ...]]:
    """Dollars per vehicle-hour of delay, and the operating coefficients, both averaged over the traffic."""
    share = sum(r[0] for r in DELAY.values())
    per_hour = sum(s / share * (occupants * dollars + freight) for s, occupants, dollars, freight in DELAY.values())
    share = sum(r[0] for r in OPERATION.values())
    weights = {k: r[0] / share * (PASSENGER_INFLATION if k in PASSENGER else COMMERCIAL_INFLATION) for k, r in OPERATION.items()}
    return per_hour, tuple(sum(weights[k] * r[i] for k, r in OPERATION.items()) for i in range(1, 6))


PER_HOUR, COEFFICIENTS = _folded()


def operating_cents(v: Column) -> Column:
    a, b, c0, c1, c2 = COEFFICIENTS
    return F.when(v == 0, F.lit(0.0)).when(v < SWITCH_KMH, a + b / v).otherwise(c0 + c1 * v + c2 * v * v)


def congestion_dollars(actual: Column, nominal: Column, vehicles: Column, km: Column) -> Column:
    """Dollars per minute; 0 at or above the nominal speed, never negative."""
    on_link = F.when(actual == 0, F.lit(0.0)).otherwise(60.0 * km / actual * vehicles)
    delay = DELAY_INFLATION * F.greatest(F.lit(0.0), 1 - actual / nominal) * PERIOD_S * on_link * PER_HOUR / 3600
    operation = (operating_cents(actual) - operating_cents(nominal)) * actual * on_link * PERIOD_S / 100 / 3600
    return F.when(actual > nominal, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), delay + operation), 2))
