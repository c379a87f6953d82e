import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lurescan.session import session

    s = session("local[4]", "tests", partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def urls(spark):
    """list of URLs -> DataFrame(url_id, url)"""
    return lambda items: spark.createDataFrame(list(enumerate(items)), "url_id bigint, url string")
