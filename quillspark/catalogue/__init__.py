"""Queries of the library's own operators by name, and SQL that gives the same rows."""

from . import extraction, library, maintenance, retrieval, vectors

QUERIES = {}
ORACLE = {}
for _m in (library, maintenance, retrieval, vectors, extraction):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
