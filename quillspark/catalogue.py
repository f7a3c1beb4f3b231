"""The queries over the review operators, with their SQL twins."""

from __future__ import annotations

from quillspark.plans import adversarial_queries as _adversarial  # noqa: F401
from quillspark.plans import inventory_queries as _inventories  # noqa: F401
from quillspark.plans import more_queries as _more  # noqa: F401  (it adds its own to the same tables)
from quillspark.plans import queries as _plans
from quillspark.plans import record_queries as _records  # noqa: F401
from quillspark.plans import section_queries as _sections  # noqa: F401
from quillspark.plans import synthesis_queries as _synthesis  # noqa: F401

FLAGSHIP = _plans.QUERIES["g10_agreement"]


def queries() -> dict:
    return dict(_plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_plans.SQL)
