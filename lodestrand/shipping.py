"""Making the package importable in Python workers wherever they run."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from lodestrand.tables import ensure_checkpoint_dir

_SHIPPED: set[str] = set()


def package_zip() -> bytes:
    """The package's sources as a zip file; the same bytes for the same sources."""
    root = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{f.relative_to(root).as_posix()}"), f.read_bytes())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Puts the package into the shared folder and on the workers' path, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    data = package_zip()
    name = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lodestrand-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        stream = fs.create(path, True)
        stream.write(bytearray(data))
        stream.close()
    sc.addPyFile(fs.getFileStatus(path).getPath().toString())
    _SHIPPED.add(sc.applicationId)
