"""Tables that are published together: readers see one version of all of them, whatever happens meanwhile.

A version is a folder of plain Parquet tables that nobody changes again. A small document names the current one; it is replaced by one
rename that file systems make atomic, after all tables of the new version are there. A driver that is lost before leaves the old
version whole, and one that reads goes on with the version that it resolved. Versions that nobody needs are cleaned up later.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from vectide.errors import ContractError
from vectide.sources.readers import _status
from vectide.sources.sinks import read_text, write_table

CURRENT, VERSIONS = "current.json", "versions"


def _current(spark: SparkSession, base: str) -> dict | None:
    files, where = _status(spark, f"{base}/{CURRENT}")
    return json.loads(read_text(spark, f"{base}/{CURRENT}")) if files.exists(where) else None


def _swap(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small document in one step."""
    jvm = spark.sparkContext._jvm
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    files, where = _status(spark, draft)
    out = files.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(files.makeQualified(where), files.makeQualified(_status(spark, path)[1]), over)


def version(spark: SparkSession, base: str) -> str:
    """The version that readers see now."""
    found = _current(spark, base.rstrip("/"))
    if found is None:
        raise ContractError(f"nothing is published at {base}")
    return found["version"]


def publish(tables: dict[str, DataFrame], base: str, expected: str | None = None, about: dict | None = None) -> str:
    """Write all tables and make them the current version; its name.

    ``expected``: the version that these tables were made from; if another one is current by then, nothing is published. Tables of the
    current version that are not given stay as they are.
    """
    spark, base = next(iter(tables.values())).sparkSession, base.rstrip("/")
    name = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"
    for table, df in tables.items():
        write_table(df, f"{base}/{VERSIONS}/{name}/{table}", overwrite=False)
    before = _current(spark, base)
    if expected is not None and (before or {}).get("version") != expected:
        _remove(spark, f"{base}/{VERSIONS}/{name}")
        raise ContractError(f"{base} has changed: {(before or {}).get('version')} is current, not {expected}")
    where = ((before or {}).get("tables") or {}) | {table: f"{VERSIONS}/{name}/{table}" for table in tables}
    _swap(spark, f"{base}/{CURRENT}", json.dumps({"version": name, "before": (before or {}).get("version"), "tables": where, "about": about or {}}, indent=2, sort_keys=True))
    return name


def read(spark: SparkSession, base: str, *tables: str) -> tuple[DataFrame, ...]:
    """Tables of the current version, all of the same one."""
    found = _current(spark, base.rstrip("/"))
    if found is None:
        raise ContractError(f"nothing is published at {base}")
    missing = [t for t in tables if t not in found["tables"]]
    if missing:
        raise ContractError(f"{base} has no table {', '.join(missing)}")
    return tuple(spark.read.parquet(f"{base.rstrip('/')}/{found['tables'][t]}") for t in tables)


def _remove(spark: SparkSession, path: str) -> None:
    files, where = _status(spark, path)
    files.delete(where, True)


def clean(spark: SparkSession, base: str, older_than_hours: float = 24.0) -> list[str]:
    """Delete tables that the current version doesn't name and that are older than any reader may be; their versions."""
    base, found = base.rstrip("/"), _current(spark, base.rstrip("/"))
    files, where = _status(spark, f"{base}/{VERSIONS}")
    if found is None or not files.exists(where):
        return []
    now, gone = datetime.now(timezone.utc).timestamp() * 1000, []
    used = set(found["tables"].values())
    for s in files.listStatus(where):
        name = s.getPath().getName()
        for t in files.listStatus(s.getPath()):
            if f"{VERSIONS}/{name}/{t.getPath().getName()}" not in used and now - t.getModificationTime() > older_than_hours * 3_600_000:
                files.delete(t.getPath(), True)
                gone.append(name)
        if not files.listStatus(s.getPath()):
            files.delete(s.getPath(), True)
    return sorted(set(gone))
