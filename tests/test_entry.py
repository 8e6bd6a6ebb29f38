"""The optional subpackage may be absent, in part or whole, without taking the rest along."""

import subprocess
import sys

import pytest

from textlens.plans import registry

CODE = """
import sys, warnings
{block}
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as e
    print(len(e.queries()), len(e.oracle_sql()), len([w for w in said if {name!r} in str(w.message)]))
"""


@pytest.mark.parametrize("name", ["xxhash", "textlens.llm.common", "textlens.llm", "corpus_pipeline", "textlens.llm.queries"])
def test_core_queries_stand_without_the_optional_parts(name):
    code = CODE.format(block=f"sys.modules[{name!r}] = None", name=name)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rpartition("/tests/")[0]).stdout.split()
    n, oracles, warned = map(int, out[-3:])
    assert (n, oracles) == (len(registry.queries()), len(registry.oracles())) and warned >= 1
