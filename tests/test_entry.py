import zipfile
from io import BytesIO

import __spark_entry__ as entry
from lodestrand import shipping


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    assert {"p2_found", "p5_found"} <= set(q)


def test_package_zip(spark):
    names = zipfile.ZipFile(BytesIO(shipping.package_zip())).namelist()
    assert "lodestrand/tables.py" in names and "lodestrand/plans/catalog.py" in names
    assert shipping.package_zip() == shipping.package_zip()
    shipping.ship(spark)
    shipping.ship(spark)


def test_columns(spark, small):
    assert entry.queries()["p2_found"](spark, small).columns == ["ref_table", "ref_field", "record_key", "state"]
    assert entry.queries()["p5_found"](spark, small).columns == ["session_id", "start_us", "end_us", "message_count"]
