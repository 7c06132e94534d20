"""The queries of this subpackage by name, with SQL where SQL can express them."""

from importlib import import_module

_MODULES = [f"op{n}" for n in range(1, 11)]

QUERIES, ORACLE_SQL = {}, {}
for _name in _MODULES:
    _m = import_module(f".{_name}", __package__)
    QUERIES[_m.NAME] = _m.query
    if _m.ORACLE:
        ORACLE_SQL[_m.NAME] = _m.ORACLE
