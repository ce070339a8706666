"""The driver contract holds without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'op8_exact_dedup' in e.queries(), 'pipeline' in e.queries())"


def shown(folder, *more):
    return subprocess.run([sys.executable, "-c", "; ".join([*more, SHOW])], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_corpus_folders(tmp_path):
    from driftline.plans import catalog

    own = [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "False", "False"]
    shutil.copytree(f"{ROOT}/driftline", tmp_path / "driftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    assert shown(tmp_path) == own
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):  # the pipeline alone can't be imported, either
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        assert shown(tmp_path) == own


def test_entry_without_a_library_of_the_corpus_operators():
    from driftline.plans import catalog

    assert shown(ROOT, "import sys", "sys.modules['public_tokenizers'] = None")[:3] == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "False"]
