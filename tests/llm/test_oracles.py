import pytest

import __spark_entry__ as entry
from oracle_check import compare

from .helpers import SMALL


@pytest.mark.parametrize("name", ["op2_quote_links", "op3_warc_normalizer", "op4_line_dedup", "op5_jaccard_join", "op7_quality_rules"])
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SMALL, verbose=False)
