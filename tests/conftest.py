import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfsight.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    from shelfsight.sources.testbed import retail_tables
    return retail_tables(spark, SF_DIR)


@pytest.fixture(scope="session")
def monthly(spark, raw):
    """The feature table of the smallest test folder, written once for all tests."""
    from shelfsight.plans.features import monthly_features
    from shelfsight.sources.staging import stage
    return stage(monthly_features(raw), "test-features")
