import __spark_entry__ as entry
import pytest
from oracle import compare

from millrace import queries


def test_entry(spark, sf):
    assert entry.entry(spark).columns == ["key", "r_val", "s_val"]


def test_every_join_query_has_a_statement():
    assert queries.QUERIES.keys() == queries.ORACLE.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_statement(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), queries.ORACLE[name], sf) >= 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(entry.__file__).parent
    shutil.copytree(top / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries()); assert 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_other_modules_that_are_missing_are_an_error(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(entry.__file__).parent
    if not (top / "millrace" / "llm").is_dir():
        pytest.skip("the subpackage was taken away")
    shutil.copytree(top / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(top / name, tmp_path)
    broken = tmp_path / "millrace" / "llm" / "packing.py"
    broken.write_text(broken.read_text() + "\nimport no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode and "no_such_module" in done.stderr
