"""A second run reads only what changed."""

import hashlib
import os

import pytest

from docsense.sources import manifest


def _found(synced):
    return {os.path.basename(r.path): (r.action, bytes(r.content)) for r in synced.changed.collect()}


def _touch(path, text, second):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (1_700_000_000 + second, 1_700_000_000 + second))


@pytest.mark.parametrize("named", [10_000, 1])
def test_sync_reads_only_what_changed(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(manifest, "NAMED", named)
    tree, store = tmp_path / "tree", f"file://{tmp_path}/store"
    for i, name in enumerate(["a.md", "b.md", "deep/c.md", "odd {x} [1].md", "skip.txt"]):
        _touch(tree / name, f"text {i}", i)
    run = lambda: manifest.sync(spark, f"file://{tree}", store, "*.md")
    first = run()
    assert first.counts == {"new": 4, "changed": 0, "touched": 0, "removed": 0, "unchanged": 0}
    assert _found(first) == {"a.md": ("new", b"text 0"), "b.md": ("new", b"text 1"), "c.md": ("new", b"text 2"), "odd {x} [1].md": ("new", b"text 3")}
    again = run()
    assert again.counts == {"new": 0, "changed": 0, "touched": 0, "removed": 0, "unchanged": 4} and _found(again) == {}
    assert manifest._versions(spark, store) == [1]

    read = []
    real = manifest.contents
    monkeypatch.setattr(manifest, "contents", lambda s, t, paths, p: read.extend(os.path.basename(r.path) for r in paths.collect()) or real(s, t, paths, p))
    _touch(tree / "a.md", "text 0", 50)  # the same text, written again
    _touch(tree / "b.md", "other", 51)
    _touch(tree / "new.md", "n", 52)
    _touch(tree / "empty.md", "", 53)
    os.remove(tree / "deep" / "c.md")
    third = run()
    assert third.counts == {"new": 1, "changed": 1, "touched": 1, "removed": 1, "unchanged": 1}
    assert _found(third) == {"b.md": ("changed", b"other"), "new.md": ("new", b"n")} and sorted(set(read)) == ["a.md", "b.md", "new.md"]
    stored = {os.path.basename(r.path): r.digest for r in manifest.current(spark, store).collect()}
    assert stored == {n: hashlib.sha256(t).hexdigest() for n, t in {"a.md": b"text 0", "b.md": b"other", "new.md": b"n", "odd {x} [1].md": b"text 3"}.items()}
    assert run().counts["unchanged"] == 4


def test_sync_of_an_empty_tree(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    synced = manifest.sync(spark, f"file://{tmp_path}/tree", f"file://{tmp_path}/store", "*.md")
    assert not any(synced.counts.values()) and synced.changed.count() == 0
