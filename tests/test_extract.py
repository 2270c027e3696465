import pytest

from labelscope.operators.extract import extract
from labelscope.operators.tables import merge_columns
from labelscope.session import materialize
from tests.cases import CASES, MERGE_ONLY, MERGED, frame


@pytest.fixture(scope="module")
def found(spark):
    """All cases as one batch of scans: nothing may leak between them."""
    lines = materialize(frame(spark, [c[0] for c in CASES.values()]))
    scans = spark.createDataFrame([(i,) for i in range(len(CASES))], "scan_id long")
    out = {}
    for row in extract(lines, scans=scans).collect():
        out.setdefault(row.scan_id, {})[row.field] = row
    return out


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    rows = found[list(CASES).index(name)]
    assert len(rows) == 11
    for key, want in CASES[name][1].items():
        if not isinstance(want, dict):
            assert rows["mrp"][key] == want, key
            continue
        for column, value in want.items():
            got = rows[key][column]
            got = got.isoformat() if hasattr(got, "isoformat") else got
            assert got == value, (key, column, rows[key])


@pytest.fixture(scope="module")
def merged(spark):
    groups = {k: CASES[k][0] for k in MERGED} | {k: c[0] for k, c in MERGE_ONLY.items()}
    lines = materialize(frame(spark, groups.values()))
    out = {k: set() for k in groups}
    for row in merge_columns(lines).filter("merged").collect():
        out[list(groups)[row.scan_id]].add(row.text)
    return out


@pytest.mark.parametrize("name", list(MERGED) + list(MERGE_ONLY))
def test_merge(merged, name):
    want = MERGED[name] if name in MERGED else MERGE_ONLY[name][1]
    assert (len(merged[name]) if isinstance(want, int) else merged[name]) == want


def test_wrapped_time_stays_out_of_expiry(found):
    row = found[list(CASES).index("wrapped value")]["expiry_date"]
    assert "13:46" not in (row.raw_text or "")
