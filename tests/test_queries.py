"""Every core query against its SQL, over the whole smallest tables; those without SQL give rows."""

from __future__ import annotations

import pytest
from compare import compare

from lodestream.plans import registries

CASES = [(r, name) for r in registries() for name in r.queries]


@pytest.mark.parametrize(("registry", "name"), CASES, ids=[n for _, n in CASES])
def test_query(spark, con, folder, registry, name):
    good, said = compare(spark, con, folder, name, registry.queries[name], registry.sql.get(name))
    assert good, said


def test_entry(spark, folder):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
