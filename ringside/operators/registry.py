"""Feature catalogue and the guard on feature versions."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import types as T

KINDS = {"float": T.DoubleType(), "str": T.StringType(), "int": T.IntegerType()}


class RegistryError(ValueError):
    """The catalogue contradicts itself or misses a family."""


class FeatureRegistry:
    """Families of columns; names are unique over all families, types are known,
    and the order is that of family names and of columns as registered."""

    def __init__(self) -> None:
        self._families: dict[str, dict[str, str]] = {}

    def register(self, family: str, columns: dict[str, str]) -> None:
        if family in self._families:
            raise RegistryError(f"family {family} is there already")
        unknown = {k for k in columns.values() if k not in KINDS}
        taken = set(columns) & {c for f in self._families.values() for c in f}
        if unknown or taken:
            raise RegistryError(f"unknown types {sorted(unknown)}, columns in use {sorted(taken)}")
        self._families[family] = dict(columns)

    def require(self, *families: str) -> None:
        if missing := sorted(set(families) - set(self._families)):
            raise RegistryError(f"families not registered: {missing}")

    def columns(self) -> list[str]:
        return [c for f in sorted(self._families) for c in self._families[f]]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, KINDS[k]) for f in sorted(self._families) for c, k in self._families[f].items()])


def source_hash(root: str, pattern: str = "**/*.py") -> str:
    """SHA-256 over the relative paths and bytes of the sources, in path order."""
    digest = hashlib.sha256()
    for p in sorted(Path(root).glob(pattern)):
        digest.update(str(p.relative_to(root)).encode() + p.read_bytes())
    return digest.hexdigest()


def check_version(manifest: str, version: int, digest: str) -> None:
    """Raise unless the manifest is there, has the version, then the hash."""
    path = Path(manifest)
    if not path.exists():
        raise RegistryError("there is no manifest")
    known = json.loads(path.read_text())
    if known.get("version") != version:
        raise RegistryError(f"manifest has version {known.get('version')}, not {version}")
    if known.get("hash") != digest:
        raise RegistryError("the sources changed without a new version")


def write_manifest(manifest: str, version: int, digest: str) -> None:
    Path(manifest).write_text(json.dumps({"version": version, "hash": digest}, indent=2))
