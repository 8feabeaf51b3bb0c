"""Every registered query against its oracle, at the smallest scale."""

import pytest

from tallyport.plans import load, registry  # noqa: F401
from tests.oracle import same

ORACLES = registry.oracles()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, name):
    if name in ORACLES:
        same(spark, data, registry.QUERIES[name], ORACLES[name])
    else:
        assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_no_optional_part():
    import subprocess
    import sys

    code = "import sys; from tallyport.plans import load; import tallyport.streaming.sessions, tallyport.sources.sinks; assert not [m for m in sys.modules if 'llm' in m or m == 'corpus_pipeline']"
    subprocess.run([sys.executable, "-c", code], check=True)
