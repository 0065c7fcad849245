import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stallbook.session import local_session  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = local_session(4, partitions=4, memory="4g", **{"spark.sql.warehouse.dir": warehouse})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("driver tables not present")
    return str(DATA)


PRICE_SCHEMA = (
    "price_id string, state string, district string, market string, commodity string, "
    "variety string, grade string, arrival_date date, min_price double, max_price double, "
    "modal_price double"
)


@pytest.fixture(scope="session")
def price_frame(spark):
    """Build observations from (market, variety, day, price) with defaults."""
    import datetime as dt

    def build(rows, commodity="Rice", state="S1", start=dt.date(2024, 1, 1)):
        out = []
        for i, row in enumerate(rows):
            row = {"market": "M1", "variety": "V", "day": i, "price": 100.0, **row}
            price = row["price"]
            day = None if row["day"] is None else start + dt.timedelta(days=row["day"])
            out.append(
                (
                    row.get("id", f"p{i:05d}"), row.get("state", state), "D1", row["market"],
                    row.get("commodity", commodity), row["variety"], "FAQ", day,
                    None if price is None else price - 1, None if price is None else price + 1, price,
                )
            )
        return spark.createDataFrame(out, PRICE_SCHEMA)

    return build
