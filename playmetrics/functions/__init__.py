from .labels import count_label, percent_label, round_half_even
from .scale import clipped_minmax
from .text import damage_text, repair_text
from .time import (calendar_columns, epoch_millis_to_local, epoch_millis_to_ts,
                   ntz_to_epoch_millis)

__all__ = [
    "count_label", "percent_label", "round_half_even", "clipped_minmax", "damage_text",
    "repair_text", "calendar_columns", "epoch_millis_to_ts", "epoch_millis_to_local",
    "ntz_to_epoch_millis",
]
