"""Git checkouts, made on the driver before any scan."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable


def _git_command(path: str, repo_url: str) -> list[str] | None:
    """What brings ``path`` up to date; None for a folder git knows nothing of."""
    if not os.path.exists(path):
        return ["git", "clone", "--depth", "1", repo_url, path]
    if os.path.exists(os.path.join(path, ".git")):
        return ["git", "-C", path, "pull", "--ff-only"]
    return None


def ensure_checkout(
    path: str, repo_url: str, update: bool = True, run: Callable = subprocess.run
) -> str:
    """Clone a missing checkout, fast-forward an existing one."""
    if update:
        command = _git_command(path, repo_url)
        if command:
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            run(command, check=True)
    elif not os.path.exists(path):
        raise FileNotFoundError(f"Docs path does not exist: {path}")
    return path
