"""File-system work of the driver, through Hadoop's interface so that any store serves."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):  # noqa: ANN202  a JVM object
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, path: str, folders: bool) -> list[str]:
    """Sorted names of the folders, or files, directly below path."""
    return sorted(x.getPath().getName() for x in _fs(spark, path).listStatus(_path(spark, path)) if x.isDirectory() == folders)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a file in one step: readers see the old text or the new."""
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    temporary = f"{path}.new"
    out = _fs(spark, temporary).create(_path(spark, temporary), True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    move(spark, temporary, path)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file; one that has the name is replaced in the same step."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(_path(spark, source), _path(spark, target), options)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder to a name that nothing has."""
    fs, to = _fs(spark, target), _path(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(_path(spark, source), to):
        raise OSError(f"{source} could not be moved to {target}")


def remove(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def times(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names of the files directly below folder, with their times of modification."""
    return {x.getPath().getName(): x.getModificationTime() for x in _fs(spark, folder).listStatus(_path(spark, folder)) if not x.isDirectory()}


def copy(spark: SparkSession, source: str, target: str) -> list[str]:
    """Copies the files directly below source, with their times, several at a time; returns their names."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    _fs(spark, target).mkdirs(_path(spark, target))

    def one(name: str) -> str:
        a, b = f"{source}/{name}", f"{target}/{name}"
        jvm.org.apache.hadoop.fs.FileUtil.copy(_fs(spark, a), _path(spark, a), _fs(spark, b), _path(spark, b), False, True, conf)
        _fs(spark, b).setTimes(_path(spark, b), _fs(spark, a).getFileStatus(_path(spark, a)).getModificationTime(), -1)
        return name

    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(one, names(spark, source, folders=False)))
