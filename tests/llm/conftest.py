"""Tables for the training-data operators: the smallest driver tables and rows that are awkward."""

import pandas as pd
import pytest
from plain import AWKWARD, DOCS, SMALL


@pytest.fixture(scope="session")
def llm(spark):
    from slatecast.llm.shared import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def documents(llm):
    return llm.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def rows():
    return pd.read_parquet(f"{SMALL}/documents.parquet").to_dict("records")


@pytest.fixture(scope="session")
def awkward(llm):
    return llm.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="session")
def no_documents(llm):
    return llm.createDataFrame([], DOCS)
