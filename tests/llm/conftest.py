import pytest

from fieldspark.llm.shared import prepare


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)
