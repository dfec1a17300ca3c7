"""Query plans; importing the package registers them all."""

from . import catalog, discovery, erp, evidence, files, prices, queue, review, settlement, stock, values, watch, web
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalog", "discovery", "erp", "evidence", "files", "prices", "queue", "review", "settlement", "stock", "values", "watch", "web"]
