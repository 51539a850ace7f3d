"""All registered queries of the core, with the SQL that gives the same rows."""

from chronoloom.plans import base, problems, queries, relation_queries, stream_queries, text_queries  # noqa: F401

QUERIES = {**problems.QUERIES, **base.QUERIES}
SQL = {**problems.SQL, **base.SQL}
