import pytest

from tempora.llm import common


@pytest.fixture(autouse=True)
def _package(spark):
    common.ship(spark)
