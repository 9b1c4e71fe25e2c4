"""The entry module imports without a session, and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = "import sys\n{}\nimport __spark_entry__ as e\nassert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150\n"


def test_imports():
    without = "class No:\n    def find_spec(self, name, *a):\n        if name.startswith(('trafficwarden.llm', 'corpus_pipeline')):\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())"
    for first in ("", without):
        subprocess.run([sys.executable, "-c", CODE.format(first)], cwd=ROOT, check=True)


def test_broken_modules_are_not_hidden():
    broken = "class No:\n    def find_spec(self, name, *a):\n        if name == 'trafficwarden.llm.common':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())"
    done = subprocess.run([sys.executable, "-c", CODE.format(broken)], cwd=ROOT, capture_output=True)
    assert done.returncode != 0 or not (ROOT / "trafficwarden" / "llm").exists()
