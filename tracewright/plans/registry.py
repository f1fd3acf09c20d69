"""Named queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from . import detection, enrichment, loading, models, templates

QUERIES = {**enrichment.QUERIES, **detection.QUERIES, **templates.QUERIES, **loading.QUERIES, **models.QUERIES}
ORACLES = {**enrichment.ORACLES, **detection.ORACLES, **templates.ORACLES, **loading.ORACLES, **models.ORACLES}
