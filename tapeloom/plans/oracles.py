"""Oracle SQL of all registered queries."""

from tapeloom.plans import market_oracles, series_oracles

ORACLES = {**series_oracles.ORACLES, **market_oracles.ORACLES}
