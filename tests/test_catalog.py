"""Every question against its SQL, on the same files. A comparison without rows is a failure, so the tiny scale uses sf0.01."""

import pytest

from tests import oracle
from tidewatch import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert oracle.differences(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name]) == ""


def test_visitor_id_is_what_hashlib_gives(spark, sf):
    import base64
    import hashlib

    salt = catalog.enrich.daily_salt(b"secret", "2024-01-10")
    got = catalog.queries()["fn_visitor_id"](spark, sf).orderBy("event_id").limit(5).collect()
    users = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id").collect()}
    for event, visitor in got:
        user = users[event]
        h = hashlib.sha256(salt)
        for part in (f"10.0.0.{user % 255}", catalog._UAS[user % len(catalog._UAS)], catalog.adapter.SITE):
            h.update(len(part.encode()).to_bytes(8, "little") + part.encode())
        assert visitor == base64.urlsafe_b64encode(h.digest()[:16]).decode().rstrip("=")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
