"""The registered queries: every operator run over the supplied tables.

Each query stands next to the SQL that a plain SQL engine runs on the same tables to
give the same rows. The tables take the roles of readings: in ``events`` the station is
the user, the parameter the event type; in ``lineitem`` the station is the supplier and
the value the quantity.
"""

from stationlake.catalog import (  # noqa: F401
    analysis,
    completeness,
    components,
    landing,
    rates,
    scalars,
    tails,
    timelines,
)
from stationlake.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
