import subprocess

import pytest
from pyspark.sql import functions as F

from revlens.operators import metrics as mt
from revlens.sources import sync as sy
from revlens.sources.tree import dump_contents, dump_tree, parse_listing, read_contents, read_listing, read_tree


def repository(root):
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ida", "-c", "user.email=ida@mill.org", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q", "-b", "main")

    def commit(message, **files):
        for name, text in files.items():
            at = root / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.unlink() if text is None else at.write_bytes(text if isinstance(text, bytes) else text.encode())
        git("add", "-A")
        git("commit", "-q", "--allow-empty", "-m", message)
        return git("rev-parse", "HEAD")

    return git, commit


def test_tree_of_a_repository(spark, tmp_path):
    git, commit = repository(tmp_path / "r")
    commit("one", **{"a b.ts": "x\n", ".gitattributes": "*.x text\n", "d/é\n.ts": "y", "bin": b"\0\1", "same.ts": "x\n", "_u.ts": "z"})
    listing = read_listing(spark, dump_tree(str(tmp_path / "r"), str(tmp_path / "l")), "r")
    got = {r["path"]: r for r in listing.collect()}
    assert set(got) == {"a b.ts", ".gitattributes", "d/é\n.ts", "bin", "same.ts", "_u.ts"} and got["bin"]["size"] == 2 and got["a b.ts"]["blob"] == git("rev-parse", "HEAD:a b.ts")
    blobs = sorted({r["blob"] for r in got.values()})
    folder = str(tmp_path / "c")
    assert dump_contents(str(tmp_path / "r"), folder, blobs) == 5 and dump_contents(str(tmp_path / "r"), folder, blobs) == 0
    tree = {r["path"]: bytes(r["content"]) for r in read_tree(listing, read_contents(spark, folder)).collect()}
    assert tree["d/é\n.ts"] == b"y" and tree["bin"] == b"\0\1" and tree[".gitattributes"] == b"*.x text\n" and tree["_u.ts"] == b"z"
    odd = spark.createDataFrame([("r", "160000 commit " + "a" * 40 + "       -\tsub"), ("r", ""), ("r", None)], "repo string, value string")
    assert parse_listing(odd).count() == 0


def state(spark, store):
    m = sy.stored_model(spark, store)
    commits = sorted(tuple(r) for r in m.commits.select("commit_id", "repo", "ts", "subject").collect())
    changes = sorted(map(tuple, m.changes.select("commit_id", "file", "added", "deleted", "alive").collect()))
    files = sorted(map(str, m.files.select("file", "path", "blob", "alive", "loc").collect()))
    return commits, changes, files


def test_partial_loads_equal_one(spark, tmp_path):
    """Three hand-overs with renames in between, an unchanged second repository, then a rewritten history: each as if loaded at once."""
    git, commit = repository(tmp_path / "r")
    _, other = repository(tmp_path / "o")
    other("there", **{"o.ts": "1\n"})
    parts, whole = str(tmp_path / "parts"), str(tmp_path / "whole")
    do = lambda store, **k: (sy.sync(spark, store, "mill", str(tmp_path / "r"), **k), sy.sync(spark, store, "other", str(tmp_path / "o"), **k))
    commit("MILL-1 one", **{"a.ts": "x\ny\nz\n", "b.ts": "1\n"})
    assert do(parts) == ("replace", "replace") and do(parts) == ("skip", "skip")
    git("mv", "a.ts", "c.ts")
    commit("two", **{"b.ts": "2\n"})
    commit("three", **{"a.ts": "new\n"})
    assert do(parts) == ("append", "skip")
    first = git("rev-parse", "HEAD")
    commit("four", **{"c.ts": "x\ny\nz\nw\n", "b.ts": None})
    assert do(parts) == ("append", "skip") and do(whole) == ("replace", "replace")
    together = state(spark, whole)
    assert state(spark, parts) == together and len(together[0]) == 5
    # History before the last commit is kept, what comes after it is another.
    git("reset", "-q", "--hard", f"{first}~1")
    commit("MILL-2 else", **{"d.ts": "q\n"})
    again = str(tmp_path / "again")
    assert do(parts) == ("replace", "skip") and do(again) == ("replace", "replace")
    together = state(spark, again)
    assert state(spark, parts) == together and {c[3] for c in together[0]} == {"MILL-1 one", "two", "MILL-2 else", "there"}
    # What was measured before is not measured again.
    assert mt.add_metrics(sy.stored_tree(spark, parts), f"{parts}/metrics", 524_288) == 0
    rows = lambda: sorted(map(str, sy.stored_log(spark, parts).collect()))
    before = rows()
    assert sy.forget_old(spark, parts) > 0 and rows() == before and sy.forget_old(spark, parts) == 0


def test_a_died_hand_over_is_not_seen(spark, tmp_path, monkeypatch):
    _, commit = repository(tmp_path / "r")
    store = str(tmp_path / "s")
    commit("one", **{"a.ts": "x\n"})
    sy.sync(spark, store, "mill", str(tmp_path / "r"))
    commit("two", **{"a.ts": "y\n"})

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(sy, "_number", lambda *_, real=sy._number, n=[]: n.append(1) or (real(*_) if len(n) < 2 else die()))
        sy.sync(spark, store, "mill", str(tmp_path / "r"))
    assert sy.stored_log(spark, store).count() == 1 and sy.stored_tree(spark, store).filter(F.col("content") == b"x\n").count() == 1
    assert sy.sync(spark, store, "mill", str(tmp_path / "r")) == "append"
    assert sorted(r["message"] for r in sy.stored_log(spark, store).collect()) == ["one", "two"]
