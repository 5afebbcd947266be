import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_queries_and_oracles_have_the_same_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_names_need_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-500:]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["confidence", "answers", "correct"] and df.count() == 3
