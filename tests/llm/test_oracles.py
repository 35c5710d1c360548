"""Text operators that SQL can express, against their SQL on two samples."""

from collections import Counter

import pytest

from checks.compare import TYPES, connect
from fleetwright.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("sample", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name, sample):
    frame = QUERIES[name](spark, sample)
    result = connect(sample).execute(ORACLES[name])
    names = [d[0] for d in result.description]
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    assert sorted(names) == sorted(types)
    assert all(types[d[0]] in TYPES[str(d[1])] for d in result.description)
    theirs = Counter(result.fetchall())
    mine = Counter(tuple(r) for r in frame.select(*names).collect())
    assert mine == theirs
