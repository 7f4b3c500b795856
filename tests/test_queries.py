"""Every registered query against its SQL."""

import os
import re

import pytest

from tramline.plans import registry

from .compare import same

Q, S = registry.queries(), registry.oracle_sql()
#: Views of whole images: the smallest size has none.
IMAGES = re.compile(r"\bdx_(px|bands)\b")


@pytest.fixture(scope="module")
def larger(sf):
    import duckdb

    path = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return path, c


@pytest.mark.parametrize("name", sorted(S))
def test_query_and_sql_agree(name, spark, sf, duck, larger):
    path, engine = larger if IMAGES.search(S[name]) else (sf, duck)
    got, want = Q[name](spark, path).toPandas(), engine.execute(S[name]).df()
    same(got, want)
    # band_sizes and the like report what is wrong, and may find nothing.
    assert len(want) or path == sf or name in ("band_sizes",)


def test_every_query_has_sql():
    assert set(Q) == set(S) and registry.FLAGSHIP in Q
