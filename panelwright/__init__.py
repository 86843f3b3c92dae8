"""Temporal panels on Spark: tables keyed by a date and an entity, with lazy operators."""

from panelwright.functions.calendars import AllDays, Calendar, DayList, Weekdays
from panelwright.panel import Panel
from panelwright.plans.batches import async_batch, batch
from panelwright.plans.held import HELD
from panelwright.plans.keys import ValidationError, normalize, validate
from panelwright.plans.settings import configure, configure_logging, default_parent_dirs, default_store_dir, get_logger, reset_settings
from panelwright.sources.store import CacheMissError, PanelStore

__all__ = [
    "HELD", "AllDays", "CacheMissError", "Calendar", "DayList", "Panel", "PanelStore", "ValidationError", "Weekdays", "async_batch", "batch",
    "configure", "configure_logging", "default_parent_dirs", "default_store_dir", "get_logger", "normalize", "reset_settings", "validate",
]
