"""Every query of the engine by name, with its DuckDB counterpart."""

from __future__ import annotations

from tidewell.plans import careers, content, feeds, newsroom, roles, site, stories, urls_and_text

QUERIES = {**urls_and_text.QUERIES, **content.QUERIES, **stories.QUERIES, **roles.QUERIES, **feeds.QUERIES, **newsroom.QUERIES, **site.QUERIES, **careers.QUERIES}
ORACLES = {**urls_and_text.ORACLES, **content.ORACLES, **stories.ORACLES, **roles.ORACLES, **feeds.ORACLES, **newsroom.ORACLES, **site.ORACLES, **careers.ORACLES}
