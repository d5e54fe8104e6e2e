"""All queries by name, with their SQL."""

from __future__ import annotations

from . import corpora, feeds, relational, retrieval, series, upkeep

QUERIES = {**retrieval.QUERIES, **corpora.QUERIES, **series.QUERIES, **relational.QUERIES, **feeds.QUERIES, **upkeep.QUERIES}
SQL = {**retrieval.SQL, **corpora.SQL, **series.SQL, **relational.SQL, **feeds.SQL, **upkeep.SQL}
