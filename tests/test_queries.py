"""Every registered query of the engine against its SQL, over the smallest tables."""

from __future__ import annotations

import pytest

from vellumgrid.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])
