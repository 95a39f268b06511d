"""The same questions in plain SQL, for checking the Spark jobs on DuckDB."""

from __future__ import annotations

import re

from oracle import cause_sql, diagnosis_sql, series_sql, text_sql, views

VIEWS: dict[str, str] = {**views.VIEWS, **series_sql.VIEWS, **cause_sql.VIEWS, **text_sql.VIEWS,
                         **diagnosis_sql.VIEWS}
ANSWERS: dict[str, str] = {**series_sql.ANSWERS, **cause_sql.ANSWERS, **text_sql.ANSWERS,
                           **diagnosis_sql.ANSWERS}

_WORD = re.compile(r"[a-z_][a-z0-9_]*")


def _needed(sql: str, known: dict[str, str], done: list[str], inside: tuple[str, ...] = ()) -> None:
    """Collect the views a statement names, dependencies first."""
    for word in dict.fromkeys(_WORD.findall(sql)):
        if word in known and word not in done and word not in inside:
            _needed(known[word], known, done, (*inside, word))
            if word not in done:
                done.append(word)


def statement(name: str) -> str:
    sql = ANSWERS[name].strip()
    known = {**VIEWS, **diagnosis_sql.OVERRIDES.get(name, {})}
    views_used: list[str] = []
    _needed(sql, known, views_used)
    if not views_used:
        return sql
    body = ",\n".join(f"{v} AS MATERIALIZED ({known[v].strip()})" for v in views_used)
    if sql.upper().startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    return f"WITH RECURSIVE {body}\n{sql}"
