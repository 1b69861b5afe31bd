from __future__ import annotations

import ntpath
import posixpath

from pyspark.sql import functions as F

from siftwell.functions import paths
from siftwell.functions.numbers import batch_count, percent_done, size_mb


def _apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


NAMES = ["f.TXT", ".bashrc", "a.", "a.tar.gz", "noext", "..x", "...", ".a.b", "", "a b.c d", "f\n.x", "ı.İ"]


def test_extension_and_stem_equal_splitext(spark):
    full = [f"C:\\dir.d\\{n}" for n in NAMES] + [f"/dir.d/{n}" for n in NAMES]
    assert _apply(spark, full, paths.extension) == [ntpath.splitext(p)[1].lower() for p in full]
    assert _apply(spark, full, paths.stem) == [ntpath.splitext(ntpath.basename(p))[0] for p in full]
    assert _apply(spark, full, paths.base_name) == [ntpath.basename(p) for p in full]
    assert _apply(spark, full, paths.dir_name) == [ntpath.dirname(p) for p in full]


def test_keys_equal_normpath(spark):
    windows = ["C:\\a\\..\\b", "c:/A//B/./c", "C:\\..\\x", "a\\..\\..\\b", "", ".", "C:\\", "\\\\srv\\share\\a\\..\\b", "C:a\\.\\b", "\\x\\..\\.."]
    assert _apply(spark, windows, paths.path_key) == [ntpath.normcase(ntpath.normpath(p)) for p in windows]
    posix = ["/a/../b", "a//b/./c", "/..", "../x/..", "", ".", "/A/b", "a/../../b"]
    assert _apply(spark, posix, lambda c: paths.path_key(c, "posix")) == [posixpath.normpath(p) for p in posix]
    uris = ["s3://bucket/a/../b", "file:/x//y"]
    assert _apply(spark, uris, lambda c: paths.path_key(c, "posix")) == ["s3://bucket/b", "file:/x/y"]


def test_roots(spark):
    roots = ["C:", "C:/", "C:\\", "C:/Users", "C:\\Users\\\\", "", "/data"]
    expected = ["C:\\", "C:\\", "C:\\", "C:\\Users\\", "C:\\Users\\", "", "\\data\\"]
    assert _apply(spark, roots, paths.normalize_root) == expected


def test_system_directories(spark):
    found = ["C:\\ProgramData\\x\\f.txt", "D:\\data\\windows\\f.txt", "C:\\Windows\\f", "relative\\f", "\\\\s\\h\\Windows\\f", "/windows/f"]
    assert _apply(spark, found, paths.not_system_dir) == [False, True, False, True, False, True]
    assert _apply(spark, ["file:/C:/Windows/f", "file:///D:/data/f", "file:/windows/f"], paths.not_system_dir) == [False, True, True]
    of_drive = _apply(spark, found, lambda c: paths.not_system_dir_of_root(c, F.lit("C:")))
    assert of_drive == [False, True, False, True, True, True]
    of_folder = _apply(spark, found, lambda c: paths.not_system_dir_of_root(c, F.lit("C:\\ProgramData")))
    assert all(of_folder)


def test_extension_lists_and_roots_ignore_case(spark):
    files = ["a.TXT", "b.log", "c", "d.txt.exe"]
    assert _apply(spark, files, lambda c: paths.ext_in(c, ["txt", ".LOG"])) == [True, True, False, False]
    assert _apply(spark, ["C:/Users/a", "c:\\usersx\\a"], lambda c: paths.under(c, "C:\\USERS")) == [True, False]


def test_numbers(spark):
    row = spark.range(1).select(
        size_mb(F.lit(1572864)).alias("mb"), percent_done(F.lit(2), F.lit(3)).alias("p"), batch_count(F.lit(2001), 1000).alias("b")
    ).first()
    assert (row.mb, row.p, row.b) == (1.5, 66, 3)
