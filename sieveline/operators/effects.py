"""A log of effects: what may happen once, whoever asks, however often.

Spark runs a task again when an executor is lost, twice when it speculates,
and a whole frame at each action. A request to a model costs money, so whether
it was sent is kept outside of tasks, in files of a folder that all of them see:

* ``<key>.claim`` is made exclusively before the effect; only who makes it may go on;
* ``<key>.outcome`` appears whole, after it, and is never replaced.

Who finds an outcome takes it. Who finds a claim without one waits: another
attempt may be at it. After ``patience`` seconds it counts as interrupted, an
outcome as any other: the effect may have happened and isn't tried again.

The folder must be a mounted file system that makes files exclusively (a
local or network one); an object store can't tell two claims apart, and an address of one is an error.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import time
import urllib.parse
import uuid
from collections.abc import Callable
from pathlib import Path


class EffectLog:
    def __init__(self, folder: str, *, patience: float = 660, pause: float = 0.2):
        parts = urllib.parse.urlparse(folder)
        if parts.scheme not in ("", "file"):
            raise ValueError(f"{folder}: an effect log needs a mounted folder")
        self.folder, self.patience, self.pause = urllib.parse.unquote(parts.path), patience, pause

    def place(self, key: str, end: str) -> Path:
        name = hashlib.sha256(key.encode()).hexdigest()
        return Path(self.folder, name[:2], f"{name}.{end}")

    def outcome(self, key: str) -> dict | None:
        with contextlib.suppress(FileNotFoundError):
            return json.loads(self.place(key, "outcome").read_text(encoding="utf-8"))
        return None

    def claimed(self, key: str) -> bool:
        """Whether the claim is ours, now and only now."""
        path = self.place(key, "claim")
        path.parent.mkdir(parents=True, exist_ok=True)
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True

    def settle(self, key: str, outcome: dict) -> dict:
        """Record an outcome, and return the one that stands: the first."""
        path = self.place(key, "outcome")
        made = path.with_suffix(f".{uuid.uuid4().hex}")
        made.write_text(json.dumps(outcome), encoding="utf-8")
        with contextlib.suppress(FileExistsError):
            os.link(made, path)
        made.unlink()
        return self.outcome(key)

    def once(self, key: str, effect: Callable[[], dict], interrupted: dict) -> dict:
        """The outcome of ``effect`` for ``key``, had now or before; ``interrupted`` where whoever had it was lost."""
        known = self.outcome(key)
        if known is not None:
            return known
        if self.claimed(key):
            return self.settle(key, effect())
        since = time.time() - self.place(key, "claim").stat().st_mtime
        until = time.monotonic() + max(0.0, self.patience - max(0.0, since))
        while (known := self.outcome(key)) is None:
            if time.monotonic() >= until:
                return self.settle(key, interrupted)
            time.sleep(self.pause)
        return known
