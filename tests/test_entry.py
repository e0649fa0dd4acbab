import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the generated tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1000


def test_library_works_without_the_optional_part(tmp_path):
    """The rest neither imports the optional subpackage nor needs it."""
    for name in ("__spark_entry__.py", "volquery"):
        target = tmp_path / name
        if (ROOT / name).is_file():
            target.write_text((ROOT / name).read_text())
        else:
            for f in (ROOT / name).rglob("*.py"):
                if "llm" not in f.relative_to(ROOT).parts:
                    out = tmp_path / f.relative_to(ROOT)
                    out.parent.mkdir(parents=True, exist_ok=True)
                    out.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline'], list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
