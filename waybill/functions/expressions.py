"""Column expressions: derived columns, delivery estimates, formats and rules on one value.

Everything here is a built-in Spark expression, so it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- derived columns ---------------------------------------------------------------------------

def hub_utilization(load: Column | str, capacity: Column | str) -> Column:
    """Load as a percentage of capacity; 0 where capacity is not positive or unknown."""
    load, capacity = (_col(c).cast("decimal(10,0)") for c in (load, capacity))
    share = F.when(capacity > 0, load / capacity * 100).otherwise(F.lit(0))
    return share.cast("decimal(5,2)")


def volume_m3(length: Column | str, width: Column | str, height: Column | str) -> Column:
    """Cubic metres from three sides in centimetres; NULL when a side is missing."""
    sides = [_col(c).cast("decimal(8,2)") for c in (length, width, height)]
    cubic_cm = sides[0] * sides[1] * sides[2]
    return (cubic_cm / F.lit(1_000_000)).cast("decimal(10,4)")


def total_cost(base: Column | str, *extras: Column | str) -> Column:
    """Base cost plus the extras, a missing extra counting as zero."""
    total = _col(base).cast("decimal(10,2)")
    for extra in extras:
        total = total + F.coalesce(_col(extra).cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)"))
    return total.cast("decimal(10,2)")


def net_profit(revenue: Column | str, costs: Column | str, kind: str = "decimal(12,2)") -> Column:
    return (_col(revenue) - _col(costs)).cast(kind)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def duration_seconds(started: Column | str, completed: Column | str) -> Column:
    """Whole seconds between two times, rounded half away from zero."""
    micros = _micros(_col(completed)) - _micros(_col(started))
    second = F.lit(1_000_000)
    away = F.call_function("div", F.abs(micros) + F.lit(500_000), second)
    return (F.signum(micros).cast("int") * away).cast("int")


def elapsed_days(started: Column | str, completed: Column | str) -> Column:
    """Whole days between two times, rounded down also when negative."""
    micros = _micros(_col(completed)) - _micros(_col(started))
    day = F.lit(86_400_000_000)
    return F.call_function("div", micros - F.pmod(micros, day), day)


# --- delivery estimate -------------------------------------------------------------------------

def delivery_days(service: Column | str, days: Mapping[str, int] = fixed.DELIVERY_DAYS) -> Column:
    """Days to deliver; an unknown or missing service counts as standard."""
    chosen = F.lit(days[fixed.DEFAULT_SERVICE])
    for name, count in days.items():
        chosen = F.when(_col(service) == name, F.lit(count)).otherwise(chosen)
    return chosen


def eta(service: Column | str, pickup: Column | str, as_of: Column,
        days: Mapping[str, int] = fixed.DELIVERY_DAYS) -> Column:
    """Pickup time (load time when unknown) plus the days of the service."""
    return F.coalesce(_col(pickup), as_of) + F.make_dt_interval(delivery_days(service, days))


# --- formats -----------------------------------------------------------------------------------

def iso_timestamp(ts: Column | str) -> Column:
    """ISO-8601 text; six fraction digits when there is a fraction, NULL stays NULL."""
    text = _col(ts).cast("timestamp_ntz").cast("string")
    fraction = F.substring(text, 21, 6)
    seconds = F.translate(F.substring(text, 1, 19), " ", "T")
    return F.when(fraction == "", seconds).otherwise(
        F.concat(seconds, F.lit("."), F.rpad(fraction, 6, "0")))


def money_to_double(amount: Column | str) -> Column:
    """Decimal money as a double; zero stays zero."""
    return _col(amount).cast("double")


def upper_code(code: Column | str) -> Column:
    return F.upper(_col(code))


def to_camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def to_snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def stable_uuid(*parts: Column | str) -> Column:
    """An identifier in UUID form, the same whenever the same parts are seen.

    A random one would change when a lost executor's task is run again.
    """
    text = F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts]))
    for place in (9, 14, 19, 24):
        text = F.overlay(text, F.lit("-"), place, 0)
    return text


# --- tracking numbers --------------------------------------------------------------------------

def tracking_base(created: Column | str) -> Column:
    """Prefix, day and the last four digits of the epoch second, rounded to the nearest."""
    created = _col(created)
    second = F.pmod(F.unix_seconds((created + F.expr("interval '0.5' second")).cast("timestamp")),
                    F.lit(10_000))
    return F.concat(F.lit(fixed.TRACKING_PREFIX), F.date_format(created, "yyyyMMdd"),
                    F.lpad(second.cast("string"), 4, "0"))


def tracking_number(created: Column | str, counter: Column | str) -> Column:
    return F.concat(tracking_base(created), F.lpad(_col(counter).cast("string"), 3, "0"))


# --- values ------------------------------------------------------------------------------------

def clamp_low(value: Column | str, low: int = 0) -> Column:
    return F.greatest(F.lit(low), _col(value))


def clamp_high(value: Column | str, high: Column | str) -> Column:
    return F.least(_col(high), _col(value))


def phone_valid(phone: Column | str) -> Column:
    """Missing and empty pass; otherwise only digits may remain without ``+``, ``-`` and space."""
    phone = _col(phone)
    digits = F.translate(phone, "+- ", "")
    return F.coalesce((phone == "") | digits.rlike("^[0-9]+$"), F.lit(True))


def initial_event(event_id: Column | str, as_of: Column) -> Column:
    """The one-element event history of a new shipment."""
    return F.array(F.struct(
        _col(event_id).alias("id"),
        as_of.alias("timestamp"),
        F.lit(fixed.INITIAL_STATUS).alias("status"),
        F.lit(fixed.INITIAL_LOCATION).alias("location"),
        F.lit(fixed.INITIAL_DESCRIPTION).alias("description"),
    ))


def timestamp(text: str) -> Column:
    """A timestamp literal without time zone."""
    return F.lit(text).cast("timestamp_ntz")
