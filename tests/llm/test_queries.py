"""The registered queries against their SQL, where SQL can express them."""

from __future__ import annotations

import pytest

from driftwell.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, same):
    same(name, QUERIES, ORACLE_SQL)


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
