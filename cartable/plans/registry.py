"""Registry of named queries: ``name -> (spark fn, oracle SQL or None)``."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def all_queries() -> dict[str, Callable]:
    from . import catalog  # noqa: F401  (registers everything)
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from . import catalog  # noqa: F401
    return {k: (v() if callable(v) else v) for k, v in ORACLES.items()}
