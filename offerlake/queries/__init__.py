"""Registered queries over the driver's tables, and the same in DuckDB SQL."""

from . import bodies, exchange, extraction, mail, offers, sync

_PARTS = (extraction, offers, sync, exchange, bodies, mail)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
