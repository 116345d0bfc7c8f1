"""The ledger of an entity's files: what is done, and what a run has claimed."""

from __future__ import annotations

import json
import threading
import time
from dataclasses import dataclass, field

from ..storage import Files, InputFile

#: Seconds that a claim and a lock are held, at most; tries for a lock.
TTL, STALE, RETRIES = 3600.0, 30.0, 5


@dataclass
class Claim:
    taken: list[InputFile] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class Ledger:
    """A JSON file, replaced as a whole under a lock file, on any storage."""

    def __init__(self, files: Files, path: str, entity: str, clock=time.time):
        self.files, self.path, self.entity, self.clock = files, path, entity, clock

    def read(self) -> dict:
        if not self.files.exists(self.path):
            return {"version": 2, "entity": self.entity, "files": {}, "claims": {}}
        data = json.loads(self.files.read(self.path))
        data.setdefault("claims", {})
        data["version"] = 2
        return data

    def _change(self, change) -> dict:
        lock = f"{self.path}.lock"
        for attempt in range(RETRIES * 20):
            if self.files.create(lock):
                break
            made = self.files.modified(lock)
            if made is not None and time.time() - made > STALE:
                self.files.delete(lock)
            time.sleep(0.01 * (attempt + 1) if attempt < 20 else 0.2)
        else:
            raise RuntimeError(f"the ledger {self.path} is locked")
        try:
            data = self.read()
            change(data)
            self.files.write(self.path, json.dumps(data, indent=1, sort_keys=True))
            return data
        finally:
            self.files.delete(lock)

    def claim(self, run_id: str, files: list[InputFile], full: bool = False) -> Claim:
        """The files that are neither done nor in another run's hands. full: done ones too."""
        out = Claim()

        def change(data: dict) -> None:
            now = self.clock()
            data["claims"] = {p: c for p, c in data["claims"].items() if c["expires"] > now}
            for f in files:
                done, held = data["files"].get(f.path), data["claims"].get(f.path)
                if done is not None and not full:
                    if (done["size"], done["mtime"]) != (f.size, f.mtime):
                        out.warnings.append(f"{f.path}: processed before and changed since, skipped")
                elif held is not None and held["run_id"] != run_id:
                    out.warnings.append(f"{f.path}: claimed by run {held['run_id']}, skipped")
                else:
                    data["claims"][f.path] = {"run_id": run_id, "expires": now + TTL, "size": f.size, "mtime": f.mtime}
                    out.taken.append(f)

        self._change(change)
        return out

    def renew(self, run_id: str) -> None:
        def change(data: dict) -> None:
            for c in data["claims"].values():
                if c["run_id"] == run_id:
                    c["expires"] = self.clock() + TTL

        self._change(change)

    def commit(self, run_id: str, full: bool = False) -> None:
        """A run's claims become done. full: they replace what was done before."""

        def change(data: dict) -> None:
            own = {p: c for p, c in data["claims"].items() if c["run_id"] == run_id}
            if full:
                data["files"] = {}
            for p, c in own.items():
                data["files"][p] = {"size": c["size"], "mtime": c["mtime"], "run_id": run_id, "at": self.clock()}
                del data["claims"][p]

        self._change(change)

    def release(self, run_id: str) -> None:
        def change(data: dict) -> None:
            data["claims"] = {p: c for p, c in data["claims"].items() if c["run_id"] != run_id}

        self._change(change)

    def reset(self) -> bool:
        there = self.files.exists(self.path)
        self.files.delete(self.path)
        return there


class Heartbeat:
    """Renews a run's claims until it is left."""

    def __init__(self, ledger: Ledger, run_id: str):
        self.ledger, self.run_id, self.stop = ledger, run_id, threading.Event()
        self.thread = threading.Thread(target=self._beat, daemon=True)

    def _beat(self) -> None:
        while not self.stop.wait(min(300.0, max(1.0, TTL / 3))):
            self.ledger.renew(self.run_id)

    def __enter__(self):
        self.thread.start()
        return self

    def __exit__(self, *_):
        self.stop.set()
