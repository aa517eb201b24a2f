"""Column expressions: everything here stays inside the JVM, no Python UDFs."""

from stopflow.functions.scalars import (
    argmax_class,
    calendar_parts,
    county_of,
    daypart,
    delay_minutes,
    epoch_shift,
    fold_window,
    haversine_km,
    is_weekend,
    load_bin,
    map_values,
    period_label,
    safe_ratio,
    window_n_min,
)

__all__ = [
    "argmax_class",
    "calendar_parts",
    "county_of",
    "daypart",
    "delay_minutes",
    "epoch_shift",
    "fold_window",
    "haversine_km",
    "is_weekend",
    "load_bin",
    "map_values",
    "period_label",
    "safe_ratio",
    "window_n_min",
]
