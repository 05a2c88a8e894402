"""Domain views and the query catalogue; importing it registers the queries of all its modules."""

from . import catalogue, network, studies

__all__ = ["catalogue", "network", "studies"]
