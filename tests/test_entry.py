import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def driver_contract():
    spec = importlib.util.spec_from_file_location("contract", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_sql_only_for_known_queries(driver_contract):
    assert set(driver_contract.oracle_sql()) <= set(driver_contract.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_flagship(spark, driver_contract):
    got = driver_contract.entry(spark)
    assert got.columns == ["label", "sentences"] and got.count() > 0
