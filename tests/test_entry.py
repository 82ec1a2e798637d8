"""The driver's entry: names, SQL for known names only, and the file that goes to executors."""

import subprocess
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert len(entry.entry(spark).columns) >= 4
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


def test_package_file_imports(tmp_path):
    path = entry._package_zip()
    code = f"import sys; sys.path = [{path!r}] + [p for p in sys.path if p]; import leafmill.operators.margins as m; print(m.__file__)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, check=True).stdout
    assert path in out
