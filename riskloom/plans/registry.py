"""Every query of the reference's own operators, and its SQL."""

from __future__ import annotations

from riskloom.plans import q_events, q_score, q_series, q_space, q_stream, q_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (q_score, q_text, q_events, q_series, q_space, q_stream):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
