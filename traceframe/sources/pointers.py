"""Generation-numbered pointers: what a folder's readers shall see, changed by one rename.

A pointer is a small text file ``generation-<number>``.  It is written under a name that
no reader looks at, closed, and then renamed, so readers find it whole or not at all;
they take the highest generation whose last line is its end mark.  Old generations stay
for readers that have just listed them, and are deleted when KEPT newer ones exist.  A
publisher that dies leaves at most a file without a reader; one that loses the race for
a number takes the next.  On a disk, a link that refuses a taken name stands for the rename.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

KEPT, TRIES = 10, 100
_NAME, _END = re.compile(r"^generation-(\d{12})$"), "end of pointer"


def _store(spark: SparkSession, root: str) -> tuple:
    """The folder as a Hadoop path, its file system, and what makes paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = path(root.rstrip("/"))
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def generations(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointers of a folder, the highest first."""
    place, store, _ = _store(spark, root)
    try:
        names = [f.getPath().getName() for f in store.listStatus(place)]
    except Py4JJavaError as e:
        if "FileNotFoundException" in e.java_exception.getClass().getName():
            return []
        raise
    return sorted((int(m[1]) for n in names if (m := _NAME.match(n))), reverse=True)


def _text(spark: SparkSession, root: str, number: int) -> str | None:
    """Text of a pointer; None if it is gone or not whole."""
    place, store, path = _store(spark, root)
    at = path(place, f"generation-{number:012d}")
    try:
        stream = store.open(at)
    except Py4JJavaError as e:
        if "FileNotFoundException" in e.java_exception.getClass().getName():
            return None
        raise
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    body, _, end = text.rpartition("\n")
    return body if end == _END else None


def latest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and text of the highest whole pointer; None if there is none."""
    for _ in range(TRIES):
        numbers = generations(spark, root)
        for number in numbers:
            if (text := _text(spark, root, number)) is not None:
                return number, text
        if not numbers or generations(spark, root) == numbers:
            return None
    raise OSError(f"the pointers of {root} change too fast to be read")


def advance(spark: SparkSession, root: str, text: str, after: int | None = None) -> int:
    """Write the next pointer and return its number.

    With ``after``, the number has to follow that one: a publisher that has worked on an
    older state gets a FileExistsError instead of undoing what another one did.
    """
    place, store, path = _store(spark, root)
    store.mkdirs(place)
    put, drop = _on_disk(place, text) if store.getUri().getScheme() == "file" else _by_rename(spark, place, store, path, text)
    try:
        for _ in range(TRIES):
            numbers = generations(spark, root)
            number = (numbers[0] if numbers else 0) + 1
            if after is not None and number != after + 1:
                raise FileExistsError(f"{root} has moved on from generation {after} to {number - 1}")
            if put(f"generation-{number:012d}"):
                for old in numbers[KEPT:]:
                    store.delete(path(place, f"generation-{old:012d}"), False)
                return number
    finally:
        drop()
    raise OSError(f"no free generation in {root} after {TRIES} tries")


Steps = tuple[Callable[[str], bool], Callable[[], None]]


def _on_disk(place, text: str) -> Steps:
    """On a disk: a link to the draft, which fails if the name is taken."""
    folder = place.toUri().getPath()
    draft = f"{folder}/.draft-{uuid.uuid4().hex}"
    with open(draft, "w", encoding="utf-8") as f:
        f.write(f"{text}\n{_END}")
        f.flush()
        os.fsync(f.fileno())

    def put(name: str) -> bool:
        try:
            os.link(draft, f"{folder}/{name}")
        except FileExistsError:
            return False
        return True

    return put, lambda: os.unlink(draft)


def _by_rename(spark: SparkSession, place, store, path, text: str) -> Steps:
    """On another store: a rename that refuses a taken name."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    kind = spark.sparkContext._gateway.new_array(rename, 1)
    kind[0] = rename.NONE
    draft = path(place, f".draft-{uuid.uuid4().hex}")
    stream = store.create(draft, False)
    try:
        stream.write(f"{text}\n{_END}".encode())
    finally:
        stream.close()

    def put(name: str) -> bool:
        try:
            context.rename(draft, path(place, name), kind)
        except Py4JJavaError:
            if not store.exists(path(place, name)):
                raise
            return False
        return True

    return put, lambda: store.delete(draft, False)
