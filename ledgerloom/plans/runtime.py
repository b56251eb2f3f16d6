"""What a process knows of the runs that it started."""

from __future__ import annotations

import threading


class Runtime:
    """States of running jobs by id, for one process; what must last is in the job table."""

    def __init__(self):
        self._states: dict[str, dict] = {}
        self._lock = threading.Lock()

    def put(self, job_id: str, **state) -> None:
        with self._lock:
            self._states.setdefault(job_id, {}).update(state)

    def get(self, job_id: str) -> dict:
        with self._lock:
            return dict(self._states.get(job_id, {}))

    def drop(self, job_id: str) -> None:
        with self._lock:
            self._states.pop(job_id, None)
