"""What lies around the reports: context files, pattern folders, and the metadata of a run."""

from __future__ import annotations

import os
import subprocess
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Folders that hold no context, the most entries below one top folder, the most files listed.
NO_CONTEXT = ("node_modules", ".git", ".verdigris", ".next", ".nuxt", ".turbo", ".svelte-kit", "target", "dist", "__pycache__", ".tox", ".venv", "venv", ".gradle", ".m2")
MOST_ENTRIES, MOST_FILES = 1000, 50

# Variables that name a branch and a commit, the strongest first, and those that tell a provider.
BRANCH_VARIABLES = ("GITHUB_HEAD_REF", "GITHUB_REF_NAME", "CI_COMMIT_BRANCH")
COMMIT_VARIABLES = ("GITHUB_SHA", "CI_COMMIT_SHA")
PROVIDERS = {"GITHUB_ACTIONS": "github-actions", "GITLAB_CI": "gitlab", "CIRCLECI": "circleci", "JENKINS_URL": "jenkins", "BUILDKITE": "buildkite", "TRAVIS": "travis"}


def pattern_folders(pattern: str) -> list[str]:
    """``a/**/b.xml`` and the like: every leading part that ends before the file and has a name without a star."""
    parts = pattern.split("/")[:-1]
    return ["/".join(parts[: i + 1]) + "/" for i in range(len(parts)) if any("*" not in p for p in parts[: i + 1])]


def context_files(spark: SparkSession, root: str, modified_after: str, reports: DataFrame) -> DataFrame:
    """``path`` of files below ``root`` that changed in a run and are no reports (``reports (doc)``).

    Folders of :data:`NO_CONTEXT` are left out, as are top folders with too many entries; the list is short by
    definition and sorted after it is cut.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("modifiedAfter", modified_after).load(root)
    found = raw.select(F.col("path").alias("doc")).withColumn("relative", F.regexp_replace("doc", f"^.*?{root.rstrip('/')}/", ""))
    for folder in NO_CONTEXT:
        found = found.filter(~F.array_contains(F.split("relative", "/"), folder))
    top = F.when(F.col("relative").contains("/"), F.substring_index("relative", "/", 1)).otherwise("")
    counted = found.withColumn("top", top).withColumn("entries", F.count("*").over(Window.partitionBy("top")))
    kept = counted.filter((F.col("top") == "") | (F.col("entries") <= MOST_ENTRIES)).join(reports.select("doc"), "doc", "left_anti")
    return kept.select(F.col("relative").alias("path")).limit(MOST_FILES).orderBy("path")


def _git(folder: str, *args: str) -> str | None:
    """One line of git's answer in a folder; null without git, a repository or an answer."""
    try:
        out = subprocess.run(["git", "-C", folder, "rev-parse", *args], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return (out.stdout.strip() or None) if out.returncode == 0 else None


def run_metadata(env: Mapping[str, str] = os.environ, folder: str = ".") -> dict[str, str | None]:
    """Branch, commit and provider of a run as the build's variables tell them, or else git in ``folder``; no branch where its head is detached."""
    first = lambda names: next((env[n] for n in names if env.get(n)), None)
    branch = first(BRANCH_VARIABLES) or _git(folder, "--abbrev-ref", "HEAD")
    return {"branch": None if branch == "HEAD" else branch, "commit_sha": first(COMMIT_VARIABLES) or _git(folder, "HEAD"), "ci_provider": next((p for v, p in PROVIDERS.items() if env.get(v)), None)}


#: Files that hold a project's settings, the first one wins.
CONFIG_FILES = (".verdigris/config.toml", "verdigris.toml")


def _text(file: Path) -> str | None:
    try:
        return file.read_text()
    except OSError:
        return None


@dataclass(frozen=True)
class Config:
    """Settings of a project; given values win over variables, these over the file, that over defaults."""

    root: str = "."
    token: str | None = None
    api_url: str | None = None
    report_patterns: tuple[str, ...] | None = None

    @classmethod
    def resolve(cls, start: str, env: Mapping[str, str] = os.environ, **given) -> Config:
        """Look for one of :data:`CONFIG_FILES` from ``start`` up; a file with errors leaves the defaults, one that can't be read is passed over."""
        out = cls(root=start)
        for folder in (Path(start).resolve(), *Path(start).resolve().parents):
            texts = [t for t in map(_text, (folder / n for n in CONFIG_FILES)) if t is not None]
            if texts:
                try:
                    data = tomllib.loads(texts[0])
                except tomllib.TOMLDecodeError:
                    data = {}
                project, test = data.get("project", {}), data.get("test", {})
                out = cls(str(folder), project.get("token"), project.get("api_url"), tuple(test["report_patterns"]) if "report_patterns" in test else None)
                break
        out = replace(out, **{f.name: env[f"VERDIGRIS_{f.name.upper()}"] for f in fields(cls) if f.name in ("token", "api_url") and env.get(f"VERDIGRIS_{f.name.upper()}")})
        return replace(out, **{k: v for k, v in given.items() if v is not None})
