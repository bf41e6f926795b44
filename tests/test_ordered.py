"""O-1 .. O-3: ordered reports come in the order of the oracle's ORDER BY."""

import pytest

import __spark_entry__ as entry
from conftest import SF001
from oracle_check import _cell, duck
from shelfwise.oracle import ORDERED


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_sequence_matches_oracle(spark, name):
    df = entry.queries()[name](spark, SF001)
    res = duck(SF001).execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = [tuple(map(_cell, r)) for r in res.fetchall()]
    got = [tuple(_cell(r[c]) for c in cols) for r in df.collect()]
    assert got == want and got
