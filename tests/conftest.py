import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from cowrie.session import make_session

    session = make_session("tests", "local[4]", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session
