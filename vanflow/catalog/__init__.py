"""Registered queries over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ("imports", "demand", "forecast", "scoring", "orders", "loop", "supervise", "texts", "learned", "streams")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for section in SECTIONS:
        merged.update(getattr(import_module(f"vanflow.catalog.{section}"), attribute))
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
