"""Geography and money expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentloom.functions.casts import col
from rentloom.schema import CITY_CENTRE, COUNTRY_BOXES, EARTH_RADIUS_KM


def distance_km(lat: str | Column, lon: str | Column, centre: tuple[float, float] = CITY_CENTRE) -> Column:
    """Great-circle distance to one point."""
    lat0, lon0 = F.radians(F.lit(centre[0])), F.radians(F.lit(centre[1]))
    lat1, lon1 = F.radians(col(lat)), F.radians(col(lon))
    half = F.pow(F.sin((lat1 - lat0) / 2), 2) + F.cos(lat1) * F.cos(lat0) * F.pow(F.sin((lon1 - lon0) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(half))


def place_label(province: str | Column, unit: str | Column) -> Column:
    return F.concat_ws(" – ", col(province), col(unit))


def boxes_at(lat: str | Column, lon: str | Column, boxes: dict = COUNTRY_BOXES) -> Column:
    """Names of the boxes that hold the point: a literal list, so no join is needed."""
    lat, lon = col(lat), col(lon)
    named = [F.when(lon.between(w, e) & lat.between(s, n), F.lit(name)) for name, (w, s, e, n) in boxes.items()]
    return F.array_compact(F.array(*named))


def monthly_amount(price: str | Column, date: str | Column, duration: str | Column) -> Column:
    """Daily prices times the days of that month; other prices unchanged."""
    days = F.day(F.last_day(col(date)))
    return F.when(col(duration) == "Daily", col(price) * days).otherwise(col(price))


def usd_amount(amount: str | Column, currency: str | Column, rate: str | Column) -> Column:
    """Non-USD amounts divided by the units per USD; no rate gives NULL."""
    return F.when(col(currency) == "USD", col(amount)).otherwise(col(amount) / F.nullif(col(rate), F.lit(0.0)))
