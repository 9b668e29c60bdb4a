"""In every SQL text each view stands after those it uses, whichever module of the catalogue is imported first."""

import subprocess
import sys
from pathlib import Path

import pytest

from catalogue import MODULES

ROOT = Path(__file__).resolve().parents[1]
ORDER = r"""
import importlib, re, sys
importlib.import_module(f"catalogue.{sys.argv[1]}")
from catalogue import all_queries
from catalogue.registry import CTES
from catalogue.views import VIEWS
queries, texts, bad = all_queries(), {**VIEWS, **CTES}, []
for name, query in queries.items():
    text = query.oracle() or ""
    defined = re.findall(r"^(?:WITH RECURSIVE )?(\w+) AS \(", text, re.M)
    defined = [d for d in defined if d in texts]
    for k, own in enumerate(defined):
        used = {u for u in re.findall(r"\{(\w+)\}", texts[own]) if u in texts}
        bad += [f"{name}: {own} before {u}" for u in used - set(defined[:k])]
sys.exit("\n".join(bad) or 0)
"""


@pytest.mark.parametrize("first", MODULES)
def test_views_stand_in_order(first):
    done = subprocess.run([sys.executable, "-c", ORDER, first], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
