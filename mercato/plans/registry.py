"""All registered queries: reports and listings, validation jobs and change jobs."""

from __future__ import annotations

from mercato.plans.catalog import QUERIES, Query
from mercato.plans.jobs import JOB_QUERIES


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = dict(QUERIES)
    out.update(JOB_QUERIES)
    return out
