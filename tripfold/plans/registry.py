"""All registered queries and their SQL. Dates and times come out as text, which every client shows alike."""

from __future__ import annotations

import functools

from tripfold.plans import conversation, itinerary, lookups, planned, planscores, preferred, rollups, toolcalls

FAMILIES = (rollups, itinerary, planned, planscores, preferred, conversation, toolcalls, lookups)
TEXT = {
    "d": ("q_overlap", "q_anti", "q_islands", "q_split", "q_timeline", "q_lastnn", "q_firstlast", "q_hotel", "q_intensity"),
    "round": ("q_repeat", "q_stopped"), "date": ("q_flatten",), "trial": ("q_utility",), "hour": ("q_window",),
}
_COLUMN = {name: column for column, names in TEXT.items() for name in names}


def _as_text(query, column: str):
    @functools.wraps(query)
    def shown(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumn(column, df[column].cast("string"))

    return shown


QUERIES, SQL = {}, {}
for family in FAMILIES:
    for name, query in family.QUERIES.items():
        column = _COLUMN.get(name)
        QUERIES[name] = _as_text(query, column) if column else query
        SQL[name] = f"SELECT * REPLACE (CAST({column} AS VARCHAR) AS {column}) FROM ({family.SQL[name]})" if column else family.SQL[name]
