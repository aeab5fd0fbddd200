import subprocess
import sys
from pathlib import Path

import __spark_entry__
import bench

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 100
    own = [n for n in bench.HEADLINE if not n.startswith("op")]
    assert set(own) <= set(queries)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert [r.bin for r in sorted(rows)] == list(range(10)) and sum(r.counts for r in rows) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_nothing_else_imports_the_text_operators():
    names = sorted(".".join(p.relative_to(ROOT).with_suffix("").parts) for p in (ROOT / "gridlark").rglob("*.py") if "llm" not in p.parts and p.name != "__init__.py")
    code = f"import sys, importlib\nfor m in {names}:\n    importlib.import_module(m)\nassert not [m for m in sys.modules if m.startswith('gridlark.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
