"""Registered queries over the driver tables (see ``registry``).

Mapping of roles onto the tables: an order is the event (time
``o_orderdate``, tie-break ``o_orderkey``), its customer / customer nation /
priority are the entities, ``o_orderstatus = 'F'`` is the binary outcome and
``lineitem`` is the one-to-many child. Importing this package registers all
queries.
"""

from . import core, cleaning, profiling, reshape, evaluation, sampling, learning  # noqa: F401
from ..registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
