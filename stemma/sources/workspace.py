"""Workspaces on the driver's disk: a listing is small and local by nature, so it is read there and handed on as a table."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def repository_dirs(workspace: str, depths: tuple[int, ...] = (1, 2)) -> list[Path]:
    """Directories at the given depths that hold ``.git`` or ``seed.yaml``; those whose name starts with a dot are left out."""
    found, level = [], [Path(workspace)]
    for depth in range(1, max(depths) + 1):
        level = sorted(d for top in level if top.is_dir() for d in top.iterdir() if d.is_dir() and not d.name.startswith("."))
        if depth in depths:
            found += [d for d in level if (d / ".git").exists() or (d / "seed.yaml").exists()]
    return found


def repositories(spark: SparkSession, workspace: str) -> DataFrame:
    return spark.createDataFrame([(d.name,) for d in repository_dirs(workspace)], "entity_id string")


def ci_state(spark: SparkSession, workspace: str) -> DataFrame:
    """entity_id, has_ci: whether a repository holds a workflow file."""
    flows = lambda d: any(f.suffix in (".yml", ".yaml") for f in (d / ".github" / "workflows").glob("*"))
    return spark.createDataFrame([(d.name, flows(d)) for d in repository_dirs(workspace)], "entity_id string, has_ci boolean")


def recent_commits(spark: SparkSession, workspace: str, since: str = "24 hours ago", timeout: int = 10) -> DataFrame:
    """entity_id, commits of repositories with recent ones; one that git can't read has none."""
    rows = []
    for d in repository_dirs(workspace, (1, 2, 3)):
        if not (d / ".git").exists():  # elsewhere git would report an enclosing repository
            continue
        try:
            out = subprocess.run(["git", "-C", str(d), "log", f"--since={since}", "--format=%H"], capture_output=True, text=True, timeout=timeout)
        except (OSError, subprocess.TimeoutExpired):
            continue
        if out.returncode == 0 and (n := len(out.stdout.split())):
            rows.append((d.name, n))
    return spark.createDataFrame(rows, "entity_id string, commits int")
