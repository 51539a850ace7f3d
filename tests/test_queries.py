import pytest
from compare import compare

from chronoloom.plans import base, catalog

SF = "/root/testdata/sf0.001"
#: Queries that may well find nothing in the smallest tables.
MAY_BE_EMPTY = {"search_edges", "search_entities", "contradictions", "pronoun_references", "search_column", "retrieve_candidates", "rank_candidates", "retrieve_for_context", "mined_patterns", "search_phrase", "search_boolean", "dedup_entities", "rule_relations", "scored_relations", "list_entities", "edges_of_hub", "search_episodes", "search_fused_source"}


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_against_sql(spark, name):
    assert name in catalog.SQL
    n = compare(spark, catalog.QUERIES[name], catalog.SQL[name], SF)
    assert n > 0 or name in MAY_BE_EMPTY
