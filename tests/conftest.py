import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def shown(v):
    """Values as text that both engines agree on."""
    import decimal

    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    return str(v)


def same_rows(df, relation):
    names = sorted(df.columns)
    told = [d[0] for d in relation.description]
    assert sorted(told) == names
    want = sorted(tuple(shown(r[told.index(c)]) for c in names) for r in relation.fetchall())
    assert sorted(tuple(shown(v) for v in r) for r in df.select(*names).collect()) == want
    return len(want)
