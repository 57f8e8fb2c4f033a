import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lumaspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = local_session("8", shuffle_partitions=4, app="tests")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep several slices on small data
    return spark
