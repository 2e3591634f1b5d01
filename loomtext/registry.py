"""All queries of the library by name, and the SQL that checks them."""

from __future__ import annotations

from .plans import content, runs, sources, streams, versions  # noqa: F401
from .plans.registering import QUERIES, SQL  # noqa: F401
