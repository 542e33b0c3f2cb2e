"""All registered queries and their SQL twins."""

from tickloom.plans import catalog_features, catalog_grading, catalog_history, catalog_pipelines

QUERIES = {}
ORACLES = {}
for part in (catalog_features, catalog_grading, catalog_history, catalog_pipelines):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)
