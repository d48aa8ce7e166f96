"""Hashes of both sides, their manifest, and a sealed bundle of what was compared."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOOL = "tracewright"
INTEGRITY_NOTE = "SHA-256 over file bytes. A digest proves that a file has not changed since; it does not prove who wrote it or when."


def hash_entries(files: DataFrame) -> DataFrame:
    """``rel_path, sha256, size_bytes, modified_at`` (ISO 8601, UTC) of readable files; the digest is computed in the JVM, next to the bytes."""
    iso = F.concat(F.date_format(F.to_utc_timestamp("mtime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return files.where("content is not null").select("rel_path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), iso.alias("modified_at"))


def manifest(side_a: DataFrame, side_b: DataFrame, label_a: str, label_b: str, reports: Iterable[Path] = (), version: str = "") -> dict:
    """Manifest of the hash entries of both sides and of report files. Labels name the folders, never by absolute path."""

    def side(entries: DataFrame, label: str) -> dict:
        files = [r.asDict() for r in entries.orderBy("rel_path").toLocalIterator()]
        return {"root": Path(label).name or label, "file_count": len(files), "files": files}

    return {
        "tool": TOOL,
        "version": version,
        "created_at": datetime.now(timezone.utc).isoformat(),
        "integrity_note": INTEGRITY_NOTE,
        "source_a": side(side_a, label_a),
        "source_b": side(side_b, label_b),
        "reports": [{"file": p.name, "sha256": file_sha256(p)} for p in reports if p.exists()],
    }


def file_sha256(path: Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as held:
        for chunk in iter(lambda: held.read(1 << 16), b""):
            digest.update(chunk)
    return digest.hexdigest()


def write_signature(path: Path) -> Path:
    """``<name>.sig`` beside a report, with its digest."""
    out = path.with_name(path.name + ".sig")
    out.write_text(f"{file_sha256(path)}  {path.name}\n", encoding="utf-8")
    return out


def write_bundle(out: Path, sides: dict[str, DataFrame], record: dict, reports: Iterable[Path] = ()) -> Path:
    """ZIP of the hashed files of each side, the manifest and the reports, with a ``.sha256`` beside it.

    File contents stream through the driver one partition at a time. A file whose bytes no longer have the manifest's digest stops the bundle.
    """
    known = {(s, f["rel_path"]): f["sha256"] for s, key in (("a", "source_a"), ("b", "source_b")) for f in record[key]["files"]}
    taken: set[str] = set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as bundle:
        for name, files in sides.items():
            for row in files.where("content is not null").select("rel_path", "content").toLocalIterator():
                data = bytes(row["content"])
                if hashlib.sha256(data).hexdigest() != known.get((name, row["rel_path"])):
                    raise ValueError(f"{name}/{row['rel_path']} is not the file that the manifest describes")
                bundle.writestr(_free(f"{name}/{row['rel_path']}", taken), data)
        for report in reports:
            bundle.write(report, _free(f"reports/{report.name}", taken))
        bundle.writestr(_free("manifest.json", taken), json.dumps(record, ensure_ascii=False, indent=2))
    out.with_name(out.name + ".sha256").write_text(f"{file_sha256(out)}  {out.name}\n", encoding="utf-8")
    return out


def _free(name: str, taken: set[str]) -> str:
    stem, n = name, 1
    while name in taken:
        n += 1
        name = f"{stem}.{n}"
    taken.add(name)
    return name
