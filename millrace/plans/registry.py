"""All queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from millrace.plans import corpus, features, history, models, paths, raster, scores, sources, streams

QUERIES = scores.QUERIES | history.QUERIES | corpus.QUERIES | features.QUERIES | paths.QUERIES | raster.QUERIES | models.QUERIES | sources.QUERIES | streams.QUERIES
ORACLES = scores.ORACLES | history.ORACLES | corpus.ORACLES | features.ORACLES | paths.ORACLES | raster.ORACLES | sources.ORACLES | streams.ORACLES
