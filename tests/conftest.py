import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from haat.session import get_spark
    base = tempfile.mkdtemp(prefix="haat-tests-")
    s = get_spark("local[4]", 4, app_name="haat-tests", extra={
        "spark.sql.warehouse.dir": f"{base}/warehouse", "spark.checkpoint.dir": f"{base}/checkpoints"})
    yield s
    s.stop()


# Micro-fixture of FIXTURES.md section 3 (as_of = 2026-01-15).
FIXTURE_ROWS = [
    (1, "2026-01-15", "clothing", 2, "100.00", 1),
    (1, "2026-01-15", "food", 1, "50.00", 1),
    (2, "2026-01-12", "clothing", 1, "120.00", 2),
    (3, "2026-01-02", "food", 4, "40.00", 3),
    (4, "2025-12-17", "toys", 3, "30.00", 1),
    (5, "2025-12-16", "clothing", 5, "90.00", 2),
    (6, "2025-11-20", "food", 10, "45.00", 3),
    (7, "2025-11-17", "toys", 2, "35.00", 4),
    (8, "2025-11-16", "toys", 1, "30.00", 4),
    (9, "2025-04-10", "cosmetics", 6, "20.00", 4),
]
AS_OF = dt.date(2026, 1, 15)


@pytest.fixture(scope="session")
def fixture_tx(spark):
    from haat.schemas import TRANSACTIONS
    rows = []
    for i, (tid, d, prod, q, price, user) in enumerate(FIXTURE_ROWS):
        day = dt.date.fromisoformat(d)
        p = Decimal(price)
        rows.append((tid, dt.datetime.combine(day, dt.time()), day, prod, prod, prod, f"{prod}-item",
                     q, float(p), (p * q).quantize(Decimal("0.01")), user, False))
    return spark.createDataFrame(rows, TRANSACTIONS)


@pytest.fixture(scope="session")
def periods():
    from haat.functions.periods import Periods
    return Periods(AS_OF)
