"""What a run was made with: library versions, the code's revision, and hashes of its sources."""

from __future__ import annotations

import hashlib
import platform
from pathlib import Path

import numpy
import pandas
import pyarrow
from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def environment(spark: SparkSession) -> dict[str, str]:
    return {"python": platform.python_version(), "spark": spark.version, "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}


def revision(start: Path = PACKAGE) -> dict[str, str | None]:
    """Branch and commit of the repository that holds a folder, read from its HEAD; None where there is none.

    A worktree's or submodule's .git file is followed, and a branch's commit is looked up among loose and packed refs.
    """
    home = next((p / ".git" for p in (start, *start.parents) if (p / ".git").exists()), None)
    if home is not None and home.is_file():
        home = (home.parent / home.read_text().partition("gitdir:")[2].strip()).resolve()
    head = home / "HEAD" if home is not None else None
    if head is None or not head.is_file():
        return {"branch": None, "commit": None}
    said = head.read_text().strip()
    if not said.startswith("ref:"):
        return {"branch": "HEAD", "commit": said}
    name = said[4:].strip()
    common = home / "commondir"
    stores = [home, *([(home / common.read_text().strip()).resolve()] if common.is_file() else [])]
    loose = [s / name for s in stores if (s / name).is_file()]
    packed = (line.split() for s in stores if (s / "packed-refs").is_file() for line in (s / "packed-refs").read_text().splitlines())
    commit = loose[0].read_text().strip() if loose else next((w[0] for w in packed if w[1:] == [name]), None)
    return {"branch": name.removeprefix("refs/heads/"), "commit": commit}


def code() -> dict[str, object]:
    """Branch, commit, and the hash of each module that a formal run uses."""
    names = sorted(p for d in ("functions", "operators", "plans", "sources") for p in (PACKAGE / d).glob("*.py"))
    hashes = {str(p.relative_to(PACKAGE)): hashlib.sha256(p.read_bytes()).hexdigest() for p in names}
    return {**revision(), "source_sha256": hashes}
