"""What a result was made with."""

from __future__ import annotations

import hashlib
import platform
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

#: Packages whose versions say how numbers were made (fixed values).
PACKAGES = ("pyspark", "numpy", "pandas", "pyarrow")


def software_versions() -> dict[str, str | None]:
    """Versions of Python and of the packages that compute; None for one that is not installed."""
    out: dict[str, str | None] = {"python": platform.python_version()}
    for name in PACKAGES:
        try:
            out[name] = version(name)
        except PackageNotFoundError:
            out[name] = None
    return out


def implementation_hash(root: str | Path | None = None) -> str:
    """SHA-256 over the names and contents of the package's Python files, in sorted order."""
    base = Path(root) if root else Path(__file__).parent.parent
    total = hashlib.sha256()
    for path in sorted(base.rglob("*.py")):
        total.update(path.relative_to(base).as_posix().encode() + b"\0" + path.read_bytes() + b"\0")
    return total.hexdigest()
