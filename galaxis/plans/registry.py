"""Named queries (spark, sf_dir) -> DataFrame, and the DuckDB SQL of those that SQL can express.

Doubles are rounded to six places, since sums run in another order there.
"""

from galaxis.plans import estimators, relational

QUERIES: dict = {**relational.QUERIES, **estimators.QUERIES}
ORACLES: dict = {**relational.ORACLES, **estimators.ORACLES}
