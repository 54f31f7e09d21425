"""All registered queries of the waveform engine and their SQL."""

from __future__ import annotations

from . import signals, spectra, stats, tables, wave

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (wave, spectra, tables, stats, signals):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
