"""File-tree source: listing, pruning, path rules, binary probe, decoding."""

import os

import pytest
from pyspark.sql import functions as F

from trawl import Query, search
from trawl.operators.filters import PathRules
from trawl.sources import files as FS


def make_tree(root):
    def put(rel, data=b"text\n"):
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data)

    put("file1.txt", b"hello world\n")
    put("file2.py", b"print('hello')\n")
    put(".hidden_file.txt", b"hidden hello\n")
    put(".hidden_dir/inside.txt", b"hello from hidden dir\n")
    put("image.png", b"not really a png")
    put("archive.ZIP", b"zip")
    put("doc.pdf", b"pdf")
    put("data.custom", b"hello custom\n")
    put("sub/nested.txt", b"nested hello\n")
    put("sub/deeper/more.md", b"# hello\n")
    put("node_modules/pkg/index.js", b"hello module\n")
    put(".git/config", b"hello git\n")
    put("build/out.txt", b"hello build\n")
    put("debug.log", b"hello log\n")
    put("nul.bin2", b"abc\x00def")
    put("noisy.txt", bytes(range(128, 256)) * 4)
    put("empty.txt", b"")
    put("latin.txt", "caf\xe9 hello\r\nnext\rline".encode("latin-1"))
    put("pkg/__init__.py", b"hello init\n")
    put("_x/y.py", b"hello underscore\n")
    put("a b.txt", b"hello space\n")
    os.symlink(root, os.path.join(root, "sub", "loop"))  # a cycle back to the root
    return root


@pytest.fixture
def tree(tmp_path):
    return make_tree(str(tmp_path / "proj"))


def rels(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.select("path").collect())


def test_default_scan(spark, tree):
    got = rels(FS.scan(spark, [tree]), tree)
    assert got == sorted(
        [
            "a b.txt", "build/out.txt", "data.custom", "empty.txt", "file1.txt", "file2.py", "latin.txt",
            "pkg/__init__.py", "sub/deeper/more.md", "sub/nested.txt", "_x/y.py",
        ]
    )


def test_include_hidden_and_custom_patterns(spark, tree):
    rules = PathRules(exclude_dot_items=False, custom_patterns=("build", "*.custom"))
    got = rels(FS.scan(spark, [tree], rules), tree)
    assert ".hidden_file.txt" in got and ".hidden_dir/inside.txt" in got
    assert ".git/config" not in got  # still an excluded directory name
    assert "build/out.txt" not in got and "data.custom" not in got
    server = rels(FS.scan(spark, [tree], PathRules.server()), tree)
    assert "build/out.txt" not in server


def test_excluded_dirs_replace_defaults(spark, tree):
    rules = PathRules(excluded_dirs=("sub",))
    got = rels(FS.scan(spark, [tree], rules), tree)
    assert "node_modules/pkg/index.js" in got
    assert not any(g.startswith("sub/") for g in got)


def test_single_file_and_missing_roots(spark, tree):
    got = rels(FS.scan(spark, [os.path.join(tree, "file1.txt"), os.path.join(tree, "nope")]), tree)
    assert got == ["file1.txt"]
    assert FS.scan(spark, [os.path.join(tree, "image.png")]).count() == 0
    hidden_root = os.path.join(tree, ".hidden_dir")
    assert rels(FS.scan(spark, [hidden_root]), tree) == [".hidden_dir/inside.txt"]


def test_multi_root_dedupe(spark, tree):
    sub = os.path.join(tree, "sub")
    both = FS.scan(spark, [tree, sub])
    assert both.count() == both.select("path").distinct().count()


def test_read_and_decode(spark, tree):
    corpus = FS.files_corpus(spark, [tree])
    texts = {os.path.relpath(r.path, tree): r.text for r in corpus.collect()}
    assert texts["latin.txt"] == "café hello\nnext\nline"  # latin-1 fallback + universal newlines
    assert texts["empty.txt"] == ""
    found = search(corpus, Query("hello"))
    assert {os.path.relpath(r.file_path, tree) for r in found.collect()} >= {"file1.txt", "latin.txt", "_x/y.py"}


def test_mtime(spark, tree):
    listed = {os.path.relpath(r.path, tree): r.mtime for r in FS.scan(spark, [tree]).collect()}
    assert listed["file1.txt"] == pytest.approx(os.path.getmtime(os.path.join(tree, "file1.txt")))
    stamped = FS.with_timestamps(spark, [os.path.join(tree, "file1.txt"), "/no/such/file"]).collect()
    assert stamped[1].mtime == 0.0


def test_root_guard_and_resolution(tmp_path):
    with pytest.raises(ValueError, match="Security/Performance"):
        FS.guard_roots(["/"], ["/"])
    with pytest.raises(ValueError, match="Path Resolution Error"):
        FS.guard_roots(["."], ["/"])
    FS.guard_roots(["/tmp"], ["/tmp"])
    (tmp_path / "ws" / "proj").mkdir(parents=True)
    assert FS.resolve_roots(["proj"], str(tmp_path / "ws")) == [str(tmp_path / "ws" / "proj")]
    assert FS.resolve_roots(["/a/../b"]) == ["/b"]


def test_unreadable_files_are_reported(spark, tmp_path):
    from trawl.sources import files as FS

    good = tmp_path / "good.txt"
    good.write_text("license")
    listing = spark.createDataFrame([(str(good), 1.0), (str(tmp_path / "gone.txt"), 1.0)], "path string, mtime double")
    assert [r.path for r in FS.read_corpus(listing).collect()] == [str(good)]
    errors = FS.read_errors(listing).collect()
    assert [(r.path, r.error.split(":")[0]) for r in errors] == [(str(tmp_path / "gone.txt"), "FileNotFoundError")]
