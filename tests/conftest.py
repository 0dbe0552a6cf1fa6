import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="flowbook-warehouse-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowbook-test-"))
    yield s


SF_SMALL = "/root/testdata/sf0.001"


def line(**terms):
    """A full-layout contract line from {column: token}; other slots 'x'."""
    from flowbook.operators.contracts import FULL_LAYOUT
    pos = {name: p for p, name, _ in FULL_LAYOUT}
    toks = ["x"] * 40
    for name, val in terms.items():
        toks[pos[name]] = val
    return ";".join(toks)


BASE_TERMS = dict(
    status_date="2014-12-31T00", role="RPA", contract_id="G1", ip_anchor="2015-07-01T00",
    ip_cycle="6M-", rate="0.04", dcc="A/360", currency="USD", deal_date="2014-12-01T00",
    ied="2015-01-01T00", md="2016-01-01T00", notional="1000", prd="NULL", pprd="NaN", td="NULL",
    ptd="NaN", sc_moc="NULL", sc_index="NaN", rr_anchor="2015-04-01T00", rr_cycle="NULL",
    rr_spread="0", rr_moc="R", rr_point="B", rr_fixing="NULL", rr_next="NaN", rr_mult="1",
    rr_term="6M", pdied="0")


@pytest.fixture
def lines_df(spark):
    def make(rows):
        return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "line_no bigint, value string")
    return make
