import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from storelens.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="storelens-test-ckpt-")
    s = get_spark("local[4]", shuffle_partitions=4, driver_memory="8g",
                  extra={"spark.checkpoint.dir": ckpt, "spark.ui.enabled": "false"})
    yield s
    s.stop()


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


MSG_COLS = ("tenant_id string, session_id string, message_id long, role string, content string, intent string, "
            "prompt_tokens long, completion_tokens long, total_tokens long, model_used string, cost double, "
            "created_at timestamp, structured_data string, latency_ms long")


def msg(t, s, mid, role, at, *, content="", intent=None, p=None, c=None, tot=None, model=None, cost=None,
        sd=None, lat=None):
    return (t, s, mid, role, content, intent, p, c, tot, model, cost, ts(at), sd, lat)
