"""Containers: what a file is by its content, the images in it, and the logical dexes of an image."""

from __future__ import annotations

import io
import struct
import zipfile

HEADER = 112
NO_SLICE = "no logical dex in image (truncated header or a file_size that does not fit the image)"


def _zip(data: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError, struct.error, NotImplementedError):
        return None


def _dex_names(names: set[str]) -> list[str]:
    """classes.dex, classes2.dex and on, up to the first gap."""
    out = []
    while (name := f"classes{len(out) + 1 if out else ''}.dex") in names:
        out.append(name)
    return out


def identify(data: bytes | None) -> dict:
    """format (dex, zip, unknown), is_apk, has_manifest, dex_count. Never raises."""
    out = {"format": "unknown", "is_apk": False, "has_manifest": False, "dex_count": 0}
    if not data:
        return out
    if data[:4] == b"dex\n":
        return out | {"format": "dex", "dex_count": 1}
    z = _zip(data)
    if z is None:
        return out
    names = set(z.namelist())
    manifest = "AndroidManifest.xml" in names
    return {"format": "zip", "is_apk": manifest, "has_manifest": manifest, "dex_count": len(_dex_names(names))}


def images(data: bytes | None) -> list[tuple[str, bytes]]:
    """(entry name, image) in load order; an entry that cannot be read has an empty image."""
    if not data:
        return []
    if data[:4] == b"dex\n":
        return [("", bytes(data))]
    z = _zip(data)
    out = []
    for name in _dex_names(set(z.namelist())) if z else ():
        try:
            out.append((name, z.read(name)))
        except Exception:  # a broken entry is a rejected image, not a failed scan
            out.append((name, b""))
    return out


def slices(image: bytes) -> list[tuple[int, int]]:
    """(offset, size) of the logical dexes: as long as a header fits and its file_size is in range; the magic is not asked for."""
    out, at = [], 0
    while at + HEADER <= len(image):
        size = struct.unpack_from("<I", image, at + 32)[0]
        if size < HEADER or at + size > len(image):
            break
        out.append((at, size))
        at += size
    return out
