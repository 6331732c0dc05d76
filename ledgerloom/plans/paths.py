"""Paths that a user gives, before any job starts."""

from __future__ import annotations

import os


def absolutize(path: str, cwd: str) -> str:
    """An absolute path without dots or doubled slashes, by its text alone: links aren't followed."""
    return os.path.normpath(os.path.join(cwd, path))


def display_path(path: str, workspace: str) -> str:
    """A path below the workspace relative to it, others as they are."""
    root = workspace.rstrip("/")
    return path[len(root) + 1 :] if path.startswith(root + "/") else "" if path == root else path


def metadata_path(path: str, workspace: str) -> str:
    """How a policy's path is recorded: an absolute one as displayed, a relative one word for word."""
    return display_path(absolutize(path, workspace), workspace) if os.path.isabs(path) else path
