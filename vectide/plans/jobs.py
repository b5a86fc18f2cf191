"""Configurations, run ids, resumable tasks."""

from __future__ import annotations

import hashlib
import json
import platform
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from vectide.errors import ContractError
from vectide.sources.readers import _status
from vectide.sources.sinks import canonical_json, read_text, write_json

#: The weights of the published sweep.
MULTIPLICATIVE_W = [0, 0.125, 0.25, 0.5, 1, 2, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 56, 64]
ADDITIVE_W = [0, 0.01, 0.03, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1, 1.5, 2, 3, 5, 10, 30, 64]
ETAS = (0.01, 0.03, 0.1)


def run_id(source: str, configuration: dict) -> str:
    """First 20 hex digits of the hash of a source's fingerprint and a configuration."""
    return hashlib.sha256(canonical_json({"source_fingerprint": source, "configuration": configuration}).encode()).hexdigest()[:20]


def fingerprint(configuration: dict) -> str:
    return hashlib.sha256(canonical_json(configuration).encode()).hexdigest()


def sweep_config(etas: tuple[float, ...] = ETAS, directions: tuple[str, ...] = ("top", "bottom")) -> dict:
    """One task for each direction and share; a baseline goes with the first direction of a share."""
    kernels = {"multiplicative": MULTIPLICATIVE_W, "additive": ADDITIVE_W}
    tasks = [{"id": f"{d}_eta_{round(100 * e):03d}", "direction": d, "eta": e, "kernels": kernels, "baseline": d == directions[0]} for e in etas for d in directions]
    return {"tasks": tasks}


def load_config(text: str) -> dict:
    """A JSON mapping, or YAML where PyYAML is installed."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ContractError("the configuration isn't JSON, and there is no YAML reader") from e
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ContractError("a configuration is a mapping")
    return found


class Lease:
    """The right to run a task: a document that only one runner can make, and that it renews by a heartbeat. One whose heartbeat has
    stopped for ``stale`` seconds is taken over."""

    def __init__(self, spark: SparkSession, path: str, owner: str, stale: float = 300.0, beat: float | None = None) -> None:
        self.spark, self.path, self.owner, self.stale = spark, path, owner, stale
        self.beat, self._stop = beat or stale / 5, threading.Event()
        self._thread: threading.Thread | None = None

    def holder(self) -> dict | None:
        """Who holds the lease, and since when there was no heartbeat, in seconds."""
        files, where = _status(self.spark, self.path)
        if not files.exists(where):
            return None
        age = time.time() - files.getFileStatus(where).getModificationTime() / 1000
        return json.loads(read_text(self.spark, self.path) or "{}") | {"silent": age}

    def _write(self, overwrite: bool) -> None:
        files, where = _status(self.spark, self.path)
        out = files.create(where, overwrite)
        out.write(bytearray(json.dumps({"owner": self.owner}).encode()))
        out.close()

    def take(self) -> bool:
        """Whether the lease is ours now. Making the document fails if another runner makes it first."""
        held = self.holder()
        if held is not None and held.get("owner") != self.owner and held["silent"] <= self.stale:
            return False
        try:
            if held is not None and held.get("owner") != self.owner:
                files, where = _status(self.spark, self.path)
                gone = _status(self.spark, f"{self.path}.gone-{self.owner}")[1]
                if not files.rename(where, gone):  # one of several that take over moves the old document away
                    return False
                files.delete(gone, False)
            self._write(overwrite=held is not None and held.get("owner") == self.owner)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e) or "FileNotFound" in str(e):
                return False
            raise
        self._stop.clear()
        self._thread = threading.Thread(target=self._beats, daemon=True)
        self._thread.start()
        return True

    def _beats(self) -> None:
        while not self._stop.wait(self.beat):
            self._write(overwrite=True)

    def release(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
        files, where = _status(self.spark, self.path)
        files.delete(where, False)


class Jobs:
    """Tasks with a status document each: one whose fingerprint and result still hold is not run again, nor one that another runner holds."""

    def __init__(self, spark: SparkSession, folder: str, source: str, stale: float = 300.0) -> None:
        self.spark, self.folder, self.source, self.stale = spark, folder.rstrip("/"), source, stale
        self.owner = f"{platform.node()}-{uuid.uuid4().hex[:12]}"

    def status(self, task: str) -> dict:
        path = f"{self.folder}/{task}.json"
        files, where = _status(self.spark, path)
        return json.loads(read_text(self.spark, path)) if files.exists(where) else {}

    def is_done(self, task: str, configuration: dict) -> bool:
        s = self.status(task)
        if s.get("state") != "done" or s.get("source") != self.source or s.get("configuration") != fingerprint(configuration):
            return False
        files, where = _status(self.spark, s["path"])
        return files.exists(where) and self.spark.read.parquet(s["path"]).limit(1).count() > 0

    def run(self, task: str, configuration: dict, work: Callable[[], str]) -> str:
        """The path of the task's result; ``work`` writes it if it isn't there."""
        if self.is_done(task, configuration):
            return self.status(task)["path"]
        lease = Lease(self.spark, f"{self.folder}/{task}.lease", self.owner, self.stale)
        if not lease.take():
            raise ContractError(f"{task} is being run by {(lease.holder() or {}).get('owner')}")
        try:
            return self._run(task, configuration, work)
        finally:
            lease.release()

    def _run(self, task: str, configuration: dict, work: Callable[[], str]) -> str:
        base = {"task": task, "source": self.source, "configuration": fingerprint(configuration)}
        now = lambda: datetime.now(timezone.utc).isoformat()
        write_json(self.spark, f"{self.folder}/{task}.json", base | {"state": "running", "started": now()})
        try:
            path = work()
        except Exception as e:
            write_json(self.spark, f"{self.folder}/{task}.json", base | {"state": "failed", "error": str(e)[:500], "ended": now()})
            raise
        write_json(self.spark, f"{self.folder}/{task}.json", base | {"state": "done", "path": path, "ended": now()})
        return path
