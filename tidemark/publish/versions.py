"""The version log of published marts: atomic swap, pins, retention (OPS-03).

``<root>/_versions`` holds one small file per version, named by its number.
A version is the whole state of the root: for every mart its folder, rows and
run. Version n + 1 is version n with the marts of one announcement replaced,
and it comes to be by creating its file where none is, so of several writers
of one number one wins and the others know. A refresh names the version that
it started from: if that is no longer the newest, it is refused.

Readers take the newest version (or the one they pinned) and never see half of
an announcement. ``clean`` removes what no kept or pinned version refers to.
"""

from __future__ import annotations

import datetime as dt
import json
import time

from pyspark.sql import SparkSession

from tidemark.publish import files

LOG, PINS = "_versions", "_pins"
#: The version before the first one.
NONE = -1


class ConcurrentRefresh(RuntimeError):
    """Another announcement came first."""


def _file(root: str, version: int) -> str:
    return f"{root}/{LOG}/{version:020d}.json"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions in the log, ascending."""
    return sorted(int(n[:-5]) for n in files.names(spark, f"{root}/{LOG}") if n.endswith(".json") and n[0] != ".")


def read_version(spark: SparkSession, root: str, version: int) -> dict | None:
    text = files.read(spark, _file(root, version))
    return None if text is None else json.loads(text)


def latest(spark: SparkSession, root: str) -> dict | None:
    """The newest version; None before the first announcement."""
    for n in reversed(numbers(spark, root)):
        if (found := read_version(spark, root, n)) is not None:  # else removed meanwhile
            return found
    return None


def commit(spark: SparkSession, root: str, run_id: str, marts: dict[str, dict], based_on: int | None = None,
           facts: dict | None = None, drop: set[str] = frozenset()) -> dict:
    """Announce ``marts`` (name -> path, rows, ...) together as the next version.

    With ``based_on`` (a number, or NONE) the announcement holds only on top of
    that version and raises ``ConcurrentRefresh`` if another came first.
    Without it the marts go on top of whatever is newest. ``facts`` are further
    entries of the version, ``drop`` names marts that it no longer has.
    """
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat()
    while True:
        base = latest(spark, root)
        number = NONE if base is None else base["version"]
        if based_on is not None and number != based_on:
            raise ConcurrentRefresh(f"{run_id} started from version {based_on}, the newest is {number}")
        own = {m: {**v, "run_id": run_id, "published_at": now} for m, v in marts.items()}
        version = {**(facts or {}), "version": number + 1, "run_id": run_id, "published_at": now,
                   "marts": {**{m: v for m, v in (base["marts"] if base else {}).items() if m not in drop}, **own}}
        if files.put_if_absent(spark, _file(root, number + 1), json.dumps(version)):
            return version
        if based_on is not None:
            raise ConcurrentRefresh(f"another announcement than {run_id} became version {number + 1}")


def pin(spark: SparkSession, root: str, name: str, version: int | None = None, hours: float = 24.0) -> dict:
    """Keep a version (the newest one by default) from ``clean`` for some
    hours, for a reader or an audit, and return it. Pins are named; a name in
    use is refused."""
    found = latest(spark, root) if version is None else read_version(spark, root, version)
    if found is None:
        raise FileNotFoundError(f"no version {'' if version is None else version} under {root}")
    entry = {"version": found["version"], "until": time.time() + 3600 * hours}
    if not files.put_if_absent(spark, f"{root}/{PINS}/{name}.json", json.dumps(entry)):
        raise FileExistsError(f"pin {name} is in use")
    # ``clean`` takes a version out of the log first and looks at the pins then:
    # either it sees this pin or we see that the version is gone.
    if read_version(spark, root, found["version"]) is None:
        unpin(spark, root, name)
        raise FileNotFoundError(f"version {found['version']} was just removed")
    return found


def unpin(spark: SparkSession, root: str, name: str) -> None:
    files.delete(spark, f"{root}/{PINS}/{name}.json")


def pinned(spark: SparkSession, root: str) -> set[int]:
    """Versions under a pin that holds; pins that have run out are removed."""
    out = set()
    for n in files.names(spark, f"{root}/{PINS}"):
        if n[0] == "." or not (text := files.read(spark, f"{root}/{PINS}/{n}")):
            continue
        entry = json.loads(text)
        if entry["until"] >= time.time():
            out.add(entry["version"])
        else:
            files.delete(spark, f"{root}/{PINS}/{n}")
    return out


def clean(spark: SparkSession, root: str, keep: int = 2, unannounced_hours: float = 24.0) -> list[str]:
    """Remove what only versions refer to that are neither among the newest
    ``keep`` nor pinned, and run folders that were never announced and have not
    changed for ``unannounced_hours`` (a failed refresh; a running one is
    younger). Returns the folders that are gone."""
    if keep < 1:
        raise ValueError("the newest version stays")
    all_numbers = numbers(spark, root)
    held = {n: v for n in all_numbers if (v := read_version(spark, root, n)) is not None}
    for n in [n for n in held if n not in set(all_numbers[-keep:]) | pinned(spark, root)]:
        files.delete(spark, _file(root, n))
        if n in pinned(spark, root):  # pinned meanwhile
            files.put_if_absent(spark, _file(root, n), json.dumps(held[n]))
    left = [v for n in numbers(spark, root) if (v := read_version(spark, root, n)) is not None]
    used = {m["path"] for v in left for m in v["marts"].values()}
    gone = sorted({m["path"] for v in held.values() for m in v["marts"].values()} - used)
    # A refresh's folder goes whole when none of its marts is in use.
    announced = {v["run_id"] for v in held.values()} | {m["run_id"] for v in held.values() for m in v["marts"].values()}
    for name, changed in files.names(spark, root).items():
        folder = f"{root}/{name}"
        if name.startswith("run_id=") and not any(u == folder or u.startswith(folder + "/") for u in used):
            if name[len("run_id="):] in announced or changed < time.time() - 3600 * unannounced_hours:
                gone = [g for g in gone if not g.startswith(folder + "/")] + [folder]
    for path in gone:
        files.delete(spark, path)
    return gone
