"""The registry of named queries over the reference's own operators."""

from . import relational, scalars, selection, series, skill, space, storage, wider

_MODULES = (scalars, relational, series, space, skill, storage, wider, selection)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: s for m in _MODULES for name, s in m.SQL.items()}
