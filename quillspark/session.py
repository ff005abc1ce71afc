"""Session defaults for local runs; a cluster brings its own settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 4, name: str = "quillspark", memory: str = "4g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(max(4, cores)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python functions find it wherever they run."""
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    here = Path(__file__).resolve().parent
    if getattr(context, "_quillspark_shipped", False) or not here.is_dir():
        return
    at = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark.zip"  # the driver's own file; Spark serves it to the executors
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path("quillspark") / p.relative_to(here))
    context.addPyFile(str(at))
    context._quillspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine may go without it: it gets a temporary folder. On a cluster that is an error."""
    import tempfile

    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def intermediate(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder; it is deleted when the driver's program ends."""
    import atexit
    import uuid

    if not _made:
        atexit.register(_clear)
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, at))
    return at


def _clear() -> None:
    for spark, at in _made:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended before; what is left lies in the folder named for it
            return
