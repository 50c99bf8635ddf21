"""All queries of the engine and the SQL that they are checked against."""

from __future__ import annotations

from . import catalog, detection, evaluation, packets, payloads

_ALL = packets.QUERIES | detection.QUERIES | catalog.QUERIES | payloads.QUERIES | evaluation.QUERIES


def _bigint_counts(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END): a BIGINT in every engine."""
    out, name = [], "count_if("
    while (at := sql.find(name)) >= 0:
        depth, end = 1, at + len(name)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[:at], "count(CASE WHEN ", _bigint_counts(sql[at + len(name) : end - 1]), " THEN 1 END)"]
        sql = sql[end:]
    return "".join(out) + sql


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _bigint_counts(sql) for name, (_, sql) in _ALL.items() if sql}
