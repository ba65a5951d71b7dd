"""Where a repository comes from: URLs, names, branches, and a local mirror. Runs on the driver."""

from __future__ import annotations

import re
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_remote(text: str) -> bool:
    return bool(re.match(r"(https?://|git@|ssh://)[^/:]+[/:]", text.strip()))


def normalize_url(text: str) -> str:
    """https://host/owner/name of the https and ssh forms; other texts as they are, trimmed."""
    t = re.sub(r"\.git/?$", "", text.strip().rstrip("/"))
    m = re.fullmatch(r"(?:ssh://)?git@([^:/]+)[:/](.+)", t)
    return f"https://{m[1]}/{m[2]}" if m else t


def owner_and_name(url: str) -> tuple[str, str]:
    parts = [p for p in re.sub(r"^[a-z]+://[^/]+/", "", normalize_url(url)).split("/") if p]
    return (parts[-2] if len(parts) > 1 else "local", parts[-1] if parts else "unknown")


def owner_column(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"\.git/?$", ""), r"[:/]([^/:]+)/[^/]+/?$", 1)


def name_column(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"\.git/?$", ""), r"([^/:]+)/?$", 1)


def git(repo: str | Path, *a: str) -> str:
    try:
        done = subprocess.run(["git", "-C", str(repo), *a], capture_output=True, text=True, check=False)
    except OSError:
        return ""
    return done.stdout.strip() if not done.returncode else ""


def metadata(repo: str | Path) -> dict[str, str]:
    url = normalize_url(git(repo, "config", "--get", "remote.origin.url"))
    owner, name = owner_and_name(url) if url else ("local", Path(repo).resolve().name)
    return {"owner": owner, "repo_name": name, "branch": git(repo, "rev-parse", "--abbrev-ref", "HEAD") or "unknown", "url": url, "display_name": f"{owner}/{name}"}


def state(repo: str | Path, at: float) -> dict:
    """What a later run needs to know of this one: the commit, the time, and the repository."""
    return {"head": git(repo, "rev-parse", "HEAD"), "analyzed_at_epoch": at, "repository": metadata(repo)}


def mirror(source: str, workspace: str | Path, keep: str = ".lodestone") -> Path:
    """A copy of a local folder, or a shallow clone of a remote repository, in the workspace.

    What the folder `keep` of an earlier copy holds stays. A clone of another origin is replaced.
    """
    _, name = owner_and_name(source) if is_remote(source) else ("", Path(source).resolve().name)
    to = Path(workspace) / name
    if is_remote(source):
        if to.exists() and normalize_url(git(to, "config", "--get", "remote.origin.url")) != normalize_url(source):
            shutil.rmtree(to)
        if to.exists():
            git(to, "fetch", "--depth", "1")
            git(to, "pull", "--ff-only")
        else:
            subprocess.run(["git", "clone", "--depth", "1", source, str(to)], check=True, capture_output=True)
        return to
    if to.resolve() == Path(source).resolve():
        return to
    to.mkdir(parents=True, exist_ok=True)
    for old in to.iterdir():
        if old.name != keep:
            shutil.rmtree(old) if old.is_dir() else old.unlink()
    shutil.copytree(source, to, dirs_exist_ok=True, ignore=shutil.ignore_patterns(keep))
    return to
