"""Named queries over the driver's tables, and the SQL that each must agree with."""

from tamarind.plans import models, outreach, relational, temporal, text

PARTS = (relational, temporal, models, text, outreach)
QUERIES = {name: run for part in PARTS for name, run in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
