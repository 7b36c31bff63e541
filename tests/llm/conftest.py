import pytest
from llm_cases import documents


@pytest.fixture
def docs(spark):
    return lambda rows: documents(spark, rows)
