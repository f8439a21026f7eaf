"""Queries of this subpackage and their oracles, by problem number."""

from __future__ import annotations

from . import boilerplate, cutoff, markup, mixing, packing, replies, scans, sentences, splitting

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (replies, boilerplate, markup, splitting, scans, cutoff, packing, mixing, sentences):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
