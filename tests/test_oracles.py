import pytest

from codonlake.plans import catalog
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    same(catalog.QUERIES[name](spark, sf), duck, catalog.ORACLES[name])
