"""Defaults for stores, and logging."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Settings:
    store_dir: str | None = None
    parent_dirs: list[str] = field(default_factory=list)


_SETTINGS = Settings()


def configure(store_dir: str | None = None, parent_dirs: list[str] | None = None) -> None:
    if store_dir is not None:
        _SETTINGS.store_dir = str(store_dir)
    if parent_dirs is not None:
        _SETTINGS.parent_dirs = [str(p) for p in parent_dirs]


def default_store_dir(spark) -> str:
    """As configured, else beside the session's warehouse, which a cluster shares."""
    return _SETTINGS.store_dir or f"{spark.conf.get('spark.sql.warehouse.dir')}/panel_store"


def default_parent_dirs() -> list[str]:
    return list(_SETTINGS.parent_dirs)


def reset_settings() -> None:
    global _SETTINGS
    _SETTINGS = Settings()


def get_logger(name: str = "panelwright") -> logging.Logger:
    return logging.getLogger(name)


def configure_logging(level: int | str = logging.INFO) -> None:
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s %(message)s")
    get_logger().setLevel(level)


@contextmanager
def timed(what: str, logger: logging.Logger | None = None):
    began = time.perf_counter()
    yield
    (logger or get_logger()).info("%s took %.3f s", what, time.perf_counter() - began)
