"""All registered queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "tile_stops_with_routes"
MODULES: tuple[str, ...] = tuple(f"tramline.plans.q_{m}" for m in ("spatial", "transit", "feeds", "map", "io", "more", "import"))


def _modules():
    import importlib

    return [importlib.import_module(m) for m in MODULES]


def queries() -> dict[str, Callable]:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _modules() for name, s in m.SQL.items()}
