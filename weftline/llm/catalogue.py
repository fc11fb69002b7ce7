"""All query modules of this subpackage, merged."""

from __future__ import annotations

from importlib import import_module

MODULES = ("accounts", "behaviour", "posts", "documents")


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"weftline.llm.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"weftline.llm.{m}").oracle_sql()
    return out
