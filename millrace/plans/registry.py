"""Queries registered by the library outside the llm subpackage."""

from __future__ import annotations

from millrace.plans import core, corpus, events, feeds, records, ruletexts, texts

QUERIES = core.QUERIES | events.QUERIES | corpus.QUERIES | feeds.QUERIES | records.QUERIES | ruletexts.QUERIES | texts.QUERIES
ORACLE = core.ORACLE | events.ORACLE | corpus.ORACLE | feeds.ORACLE | records.ORACLE | ruletexts.ORACLE | texts.ORACLE
