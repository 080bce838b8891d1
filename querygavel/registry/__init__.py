"""Registered queries: name to (query, SQL that DuckDB checks it with, or None)."""

from querygavel.registry import scores, surface, tables, texts

REGISTERED = {**scores.QUERIES, **texts.QUERIES, **tables.QUERIES, **surface.QUERIES}
