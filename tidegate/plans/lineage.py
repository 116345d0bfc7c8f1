"""OpenLineage events over HTTP: three tries each, and silence after several failures."""

from __future__ import annotations

import datetime
import json
import time
import urllib.request
import uuid
from collections.abc import Callable
from typing import Any

from .config import Entity, Lineage

WAITS = (0.0, 0.1, 0.5)


class Emitter:
    def __init__(self, config: Lineage, run_id: str, send: Callable[[str, bytes, dict[str, str], float], None] | None = None):
        self.config, self.run_id, self.failures = config, str(uuid.uuid5(uuid.NAMESPACE_URL, run_id)), 0
        self.send = send or self._post

    @staticmethod
    def _post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> None:
        urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout).close()

    def _emit(self, kind: str, e: Entity) -> bool:
        if self.failures >= self.config.max_failures:
            return False
        event: dict[str, Any] = {
            "eventType": kind, "eventTime": datetime.datetime.now(datetime.UTC).isoformat(), "producer": self.config.producer or "tidegate",
            "run": {"runId": self.run_id}, "job": {"namespace": self.config.namespace, "name": f"{self.config.job_name or 'tidegate'}.{e.name}"},
            "inputs": [{"namespace": self.config.namespace, "name": e.source.path}], "outputs": [{"namespace": self.config.namespace, "name": e.sink.accepted.path}],
        }
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.config.api_key}"} if self.config.api_key else {})
        for wait in WAITS:
            time.sleep(wait)
            try:
                self.send(self.config.url, json.dumps(event).encode(), headers, self.config.timeout_secs)
                self.failures = 0
                return True
            except OSError:
                continue
        self.failures += 1
        return False

    def start(self, e: Entity) -> bool:
        return self._emit("START", e)

    def finish(self, e: Entity, status: str) -> bool:
        return self._emit("COMPLETE" if status in ("success", "success_with_warnings", "rejected") else "FAIL", e)
