import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["level", "tile_x", "tile_y", "n_sources", "finest_res"]
    assert df.count() > 0


def test_oracle_keys_are_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 100


def test_entry_without_the_optional_folder():
    """The rest must work where the corpus operators are not there."""
    hide = "import sys; sys.modules['terrapyr.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'J1_tile_coverage' in e.queries(); assert not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", hide], cwd=ROOT, check=True)


def test_nothing_else_imports_the_optional_folder():
    for p in (ROOT / "terrapyr").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "terrapyr").parts:
            assert "llm" not in p.read_text(), p
