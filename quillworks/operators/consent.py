"""Nothing leaves the machine without a yes: asked before a plan with a network judge is built."""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Callable, Sequence

ENV = "QUILLWORKS_SEND"


class ConsentError(RuntimeError):
    """No consent: exit code 3."""


def destinations(urls: Sequence[str]) -> list[str]:
    """Distinct hosts, sorted."""
    from urllib.parse import urlparse

    return sorted({urlparse(u).netloc or u for u in urls})


def disclosure(hosts: Sequence[str], paragraphs: int) -> str:
    return f"{paragraphs} paragraphs of your text would be sent to {', '.join(hosts)}."


def stored(path: str) -> set[str]:
    try:
        with open(path, encoding="utf-8") as f:
            v = json.load(f)
        return {h for h in v.get("send_to", []) if isinstance(h, str)} if isinstance(v, dict) else set()
    except (OSError, ValueError):
        return set()


def remember(path: str, hosts: Sequence[str]) -> None:
    os.makedirs(os.path.dirname(path), mode=0o700, exist_ok=True)
    new = f"{path}.new"
    with open(os.open(new, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, stat.S_IRUSR | stat.S_IWUSR), "w", encoding="utf-8") as f:
        json.dump({"send_to": sorted(stored(path) | set(hosts))}, f)
    os.replace(new, path)


def request(hosts: Sequence[str], paragraphs: int, path: str, yes: bool = False, env: dict[str, str] | None = None, ask: Callable[[str], str] | None = None) -> str:
    """How consent was given: env, yes, stored or asked; ConsentError if it was not.  ask is None without a terminal."""
    named = {h.strip() for h in (env or {}).get(ENV, "").split(",") if h.strip()}
    if set(hosts) <= named:
        return "env"
    if yes:
        return "yes"
    if set(hosts) <= stored(path):
        return "stored"
    if ask is None:
        raise ConsentError(disclosure(hosts, paragraphs) + " Say yes on the command line to allow it.")
    answer = ask(disclosure(hosts, paragraphs) + " Send? [y/N/always] ").strip().lower()
    if answer == "always":
        remember(path, hosts)
    if answer not in ("y", "yes", "always"):
        raise ConsentError("not sent")
    return "asked"
