"""Column helpers against the Python functions they stand for."""

import fnmatch
import os

from pyspark.sql import functions as F

from trawl.functions.paths import basename, extension, glob_to_java, relative_path
from trawl.functions.text import highlight, newline_lines, number_prefix, splitlines

LINES = [
    "", "\n", "a", "a\n", "a\nb", "a\n\nb\n", "a\r\nb", "a\rb\n", "x\x0by\x0cz", "p\x1cq\x1dr\x1es",
    "u\x85v", "w x y\n", "\n\n", "a\r\n", "\r", "\r\r\n", "tail\x0c",
]


def test_splitlines_both_forms(spark):
    df = spark.createDataFrame([(c,) for c in LINES], "t string")
    t = F.col("t")
    got = df.select(splitlines(t).alias("a"), splitlines(t, newline_lines(t)).alias("b")).collect()
    for c, r in zip(LINES, got):
        assert r.a == c.splitlines() == r.b, repr(c)


NAMES = [
    "a.log", "x.LOG", "dir/a.log", "a.tmp", ".env", "__init__.py", "a b.txt", "[x].txt", "doc_12.txt",
    "doc_2x.txt", "src7/en/doc_15.txt", "build", "a.tar.gz", "weird[.txt", "new\nline.txt", "ü.md",
]
GLOBS = ["*.log", "*.tmp", "doc_2?.txt", "src7/*/doc_1*", "[!a]*", "[a-c]*", "*[.]txt", "weird[.txt", "build", "*", "?", "[]x]*", "ü*"]


def test_glob_to_java_equals_fnmatch(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    cols = [F.col("n").rlike(glob_to_java(g)).alias(f"g{i}") for i, g in enumerate(GLOBS)]
    for r in df.select("n", *cols).collect():
        for i, g in enumerate(GLOBS):
            assert r[f"g{i}"] == fnmatch.fnmatchcase(r.n, g), (r.n, g)


def test_extension_basename_relpath(spark):
    paths = ["/a/b.txt", "/a/.bashrc", "/a/..x", "/a/a.tar.GZ", "/a/noext", "/a/b.", "/a/.x.pdf", "/r", "/r/s/t.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select(
        extension(F.col("p")).alias("e"), basename(F.col("p")).alias("b"), relative_path(F.col("p"), F.lit("/r")).alias("r")
    ).collect()
    for p, r in zip(paths, got):
        assert r.e == os.path.splitext(p)[1].lower(), p
        assert r.b == os.path.basename(p), p
        if p == "/r" or p.startswith("/r/"):
            assert r.r == os.path.relpath(p, "/r"), p


def test_number_prefix_and_highlight(spark):
    df = spark.createDataFrame([(n,) for n in [1, 42, 9999, 10000, 123456]], "n int")
    assert [r.p for r in df.select(number_prefix(F.col("n")).alias("p")).collect()] == [
        f"{n: >4}: " for n in [1, 42, 9999, 10000, 123456]
    ]
    rows = [("hello", 1, 3), ("hi", 5, 9), ("", 0, 0), ("abc", 3, 3)]
    df = spark.createDataFrame(rows, "l string, s int, e int")
    got = [r.h for r in df.select(highlight(F.col("l"), F.col("s"), F.col("e")).alias("h")).collect()]
    assert got == ["h>>>el<<<lo", "hi>>><<<", ">>><<<", "abc>>><<<"]
