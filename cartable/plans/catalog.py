"""All registered queries (one per operator of the inventory)."""
from __future__ import annotations

from . import catalog_eval  # noqa: F401
from . import catalog_models  # noqa: F401
from . import catalog_runs  # noqa: F401
from . import catalog_text  # noqa: F401
from . import flagship
from .registry import register

register("v08_top_terms_per_label", flagship.oracle)(flagship.query)
