import os
import signal
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from oracle_check import session

    s = session(4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


LIMIT_S = 900


@pytest.fixture(autouse=True)
def time_limit():
    """A test that hangs fails by itself and leaves the others to run."""

    def stop(*_):
        raise TimeoutError(f"the test took more than {LIMIT_S} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(LIMIT_S)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)
