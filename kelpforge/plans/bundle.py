"""Context bundles: sections of public records as one canonical JSON document, hashed and reproducible."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import canonical

SCHEMA_VERSION = "context-bundle.v1"


def readiness(blockers: list[str], warnings: list[str]) -> dict:
    """Distinct sorted reasons, and a score from 100 less 25 for each blocker and 5 for each warning."""
    blockers, warnings = sorted(set(blockers)), sorted(set(warnings))
    status = "blocked" if blockers else "warning" if warnings else "ready"
    return {"status": status, "blockers": blockers, "warnings": warnings, "score": min(100, max(0, 100 - 25 * len(blockers) - 5 * len(warnings)))}


def bundle(sections: dict[str, DataFrame], blockers: list[str], warnings: list[str]) -> DataFrame:
    """One row ``bundle, sha256``: the published sections, ordered by id, with their readiness and hash.

    A bundle is a published document, small by its nature; each section is one sorted list of JSON rows.
    """
    out = None
    for name, rows in sections.items():
        listed = rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("id", *[c for c in rows.columns if c != "id"]))), lambda x: x)).alias(name))
        out = listed if out is None else out.join(listed)
    ready = canonical(readiness(blockers, warnings))

    @F.pandas_udf("bundle string, sha256 string")
    def build(parts):
        import pandas as pd

        made = [canonical({"schema_version": SCHEMA_VERSION, "readiness": json.loads(ready)} | {k: json.loads(v) for k, v in row.items()}) for row in parts.to_dict("records")]
        return pd.DataFrame({"bundle": made, "sha256": [hashlib.sha256(x.encode()).hexdigest() for x in made]})

    return out.select(build(F.struct(*sections)).alias("b")).select("b.bundle", "b.sha256")


def write_bundle(document: str, path: str | Path, *, check: bool = False) -> bool:
    """Writes pretty sorted JSON; returns whether it differs from what is there. With ``check`` nothing is written."""
    text = json.dumps(json.loads(document), indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    target = Path(path)
    changed = not target.exists() or target.read_text(encoding="utf-8") != text
    if changed and not check:
        target.write_text(text, encoding="utf-8")
    return changed
