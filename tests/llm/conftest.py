import pytest
from llm_cases import as_docs, edge_rows


@pytest.fixture(scope="session")
def edge(spark):
    return as_docs(spark, edge_rows())


@pytest.fixture(scope="session")
def nothing(spark, edge):
    return edge.limit(0)
