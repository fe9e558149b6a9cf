"""SQL text of ordered folds: a recursive query that joins each step to the next row of its series."""

from __future__ import annotations

EV = """ev AS (
    SELECT user_id AS series_id, event_id, epoch_us(ts) / 1e6 - 1704067200.0 AS t, value AS y,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS k
    FROM events
)"""


def chain(source: str, stages: list[dict[str, str]]) -> str:
    """Nested selects, each adding its expressions."""
    for stage in stages:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {source})"
    return source


def fold(state: dict[str, float], stages: list[dict[str, str]], columns: list[str], name: str = "f") -> str:
    """CTE ``name`` (after ev): series_id, k, event_id, t, y and the columns; previous state is prev_<field>."""
    out = ", ".join(["series_id", "k", "event_id", "t", "y", *columns])
    start = chain(f"(SELECT *, {', '.join(f'CAST({v} AS DOUBLE) AS prev_{n}' for n, v in state.items())} FROM ev WHERE k = 0)", stages)
    after = chain(f"(SELECT e.*, {', '.join(f'p.{n} AS prev_{n}' for n in state)} FROM {name} p JOIN ev e ON e.series_id = p.series_id AND e.k = p.k + 1)", stages)
    return f"{name} AS (SELECT {out} FROM {start} UNION ALL SELECT {out} FROM {after})"


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
