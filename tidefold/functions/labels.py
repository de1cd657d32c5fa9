"""State and record-type names, and small clamps and defaults, as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidefold.schema import RECORD_TYPES, STATES, TERMINAL


def _name(column: Column, names: dict[int, str], unknown: str) -> Column:
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in names.items()))
    return F.coalesce(F.try_element_at(pairs, column.cast("int")), F.format_string(f"{unknown}(%d)", column.cast("int")))


def state_name(number: Column) -> Column:
    """The text of a state number; numbers without one read state(n)."""
    return _name(number, STATES, "state")


def record_name(number: Column) -> Column:
    return _name(number, RECORD_TYPES, "record")


def state_number(name: Column) -> Column:
    """The number of a state's text, null for unknown text."""
    pairs = F.create_map(*chain.from_iterable((F.lit(v), F.lit(k)) for k, v in STATES.items()))
    return F.try_element_at(pairs, name)


def is_terminal(state: Column) -> Column:
    return state.isin(*TERMINAL)


def cancel_label(state: Column, cancel_req: Column) -> Column:
    """What a cancel request answers: a leased job that is to stop is cancelling."""
    return F.when((state == "leased") & cancel_req, F.lit("cancelling")).otherwise(state)


def or_default(column: Column, value) -> Column:
    """The value for null and for the type's zero ('' or 0)."""
    zero = F.lit("") if isinstance(value, str) else F.lit(0)
    return F.coalesce(F.nullif(column, zero), F.lit(value))


def worker_name(name: Column, host: Column, process: Column) -> Column:
    """A worker's name, by default its host and process."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat_ws("-", host, process.cast("string")))


def micros(column: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC."""
    return F.unix_micros(column.cast("timestamp"))


def split_list(column: Column) -> Column:
    """A comma-separated list, trimmed."""
    return F.transform(F.split(column, ","), lambda x: F.trim(x))
