"""All query modules of the core, merged."""

from __future__ import annotations

from importlib import import_module

MODULES = ("activity", "interactions", "accounts", "extras", "summaries", "discovery")


# Queries without SQL, and why.
NO_SQL = {
    "functional_bots": "sequence matching in Python",
    "posts_without_bots": "needs functional_bots",
    "kmeans_accounts": "Lloyd's iterations from a random start",
    "post_clusters": "Lloyd's iterations from a random start",
}


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"weftline.plans.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"weftline.plans.{m}").oracle_sql()
    return out
