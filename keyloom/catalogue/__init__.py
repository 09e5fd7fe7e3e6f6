"""All registered queries."""

from keyloom.catalogue import discovery, quality, relational, scalars, sources, state  # noqa: F401
from keyloom.catalogue.registry import ORACLES, QUERIES  # noqa: F401
