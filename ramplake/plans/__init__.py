"""Registered queries: every operator bound to the given tables, with its SQL twin."""

from ramplake.plans import decide, detect, joins, match, models, qc, scalar, scoring, sources, stations, streams, timegrid  # noqa: F401
from ramplake.plans.timegrid import flagship  # noqa: F401
