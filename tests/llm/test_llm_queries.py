"""Every query of the subpackage against its SQL; those without SQL give rows."""

from __future__ import annotations

import pytest
from compare import compare

from lodestream.llm.queries import REGISTRY


@pytest.mark.parametrize("name", list(REGISTRY.queries))
def test_query(spark, con, folder, name):
    good, said = compare(spark, con, folder, name, REGISTRY.queries[name], REGISTRY.sql.get(name))
    assert good, said
