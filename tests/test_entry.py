"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, any(k.startswith('op1_') for k in q), set(s) <= set(q))"


def copied(tmp_path, *without):
    for name in ("waypost", "__spark_entry__.py", "corpus_pipeline.py"):
        if not (ROOT / name).exists() or name in without:
            continue
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        else:
            shutil.copy(ROOT / name, tmp_path / name)
    for name in without:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
    return tmp_path


def said(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("without", [("waypost/llm",), ("waypost/llm", "corpus_pipeline.py")])
def test_places_stand_without_the_subpackage(tmp_path, without):
    out = said(copied(tmp_path, *without))
    assert out.returncode == 0, out.stderr
    n, m, pipeline, op1, within = out.stdout.split()
    assert int(n) > 80 and int(m) > 80 and (pipeline, op1, within) == ("False", "False", "True")


def test_places_stand_with_an_empty_folder_of_the_subpackage(tmp_path):
    folder = copied(tmp_path, "waypost/llm")
    (folder / "waypost/llm/__pycache__").mkdir(parents=True)
    assert said(folder).returncode == 0


def test_broken_imports_are_not_hidden(tmp_path):
    if not (ROOT / "waypost/llm").exists():
        pytest.skip("the subpackage isn't here")
    folder = copied(tmp_path)
    catalog = folder / "waypost/llm/catalog.py"
    catalog.write_text(
        "import no_such_module\n" + catalog.read_text().replace("from __future__ import annotations", "")
    )
    out = said(folder)
    assert out.returncode != 0 and "no_such_module" in out.stderr


def test_workers_get_the_package(tmp_path):
    import zipfile

    import __spark_entry__

    names = zipfile.ZipFile(__spark_entry__._packed()).namelist()
    assert "waypost/__init__.py" in names and all(n.endswith(".py") for n in names)
