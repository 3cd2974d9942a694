"""platter: order, menu, stock and wallet analytics as Spark DataFrame jobs.

``Tables`` holds one snapshot of the five business tables.  Reports
(``platter.plans``) read a snapshot, state changes (``platter.operators``)
turn a snapshot and a frame of requests into a new snapshot plus rejects.
"""

from platter.schema import Tables
from platter.session import build_session

__all__ = ["Tables", "build_session"]
