"""The file source: one tree read as a batch and as a stream."""

import os

import pytest

from loomspan.sources import files


@pytest.fixture
def root(tmp_path):
    own, outside = tmp_path / "project", tmp_path / "outside"
    for name, text in (("a.py", "a"), ("src/b.py", "b"), ("src/deep/c.md", "c"), ("node_modules/x.js", "no"), ("src/.git/config", "no"), ("pic.png", "no"), (".env.local", "no")):
        (own / name).parent.mkdir(parents=True, exist_ok=True)
        (own / name).write_text(text)
    (own / "src" / "bad.txt").write_bytes(b"\xff\xfe")
    (own / "src" / "big.txt").write_bytes(b"x" * (2 << 20) + b"x")
    outside.mkdir()
    (outside / "o.py").write_text("o")
    (own / "src" / "loop").symlink_to(own)
    (own / "again").symlink_to(own / "src")
    (own / "out1").symlink_to(outside)
    (own / "out2").symlink_to(outside)
    (own / "one.py").symlink_to(own / "a.py")
    (own / "two.py").symlink_to(outside / "o.py")
    (own / "broken").symlink_to(own / "nowhere")
    return own


def rows(df):
    return sorted((r.file_path, r.content, r.language) for r in df.collect())


PLAIN = [("a.py", "a", "python"), ("src/b.py", "b", "python"), ("src/deep/c.md", "c", "markdown")]


def test_batch_and_stream_agree(spark, root, tmp_path):
    assert rows(files.walked_files(spark, str(root))) == PLAIN
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def streamed():
        q = files.walked_files(spark, str(root), stream=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(spark.read.parquet(out))

    assert streamed() == PLAIN
    assert streamed() == PLAIN  # nothing has changed
    (root / "src" / "b.py").write_text("b2")
    (root / "new").mkdir()
    (root / "new" / "n.py").write_text("n")
    assert streamed() == sorted([*PLAIN, ("new/n.py", "n", "python"), ("src/b.py", "b2", "python")])
    assert rows(files.walked_files(spark, str(root))) == sorted([("new/n.py", "n", "python"), ("src/b.py", "b2", "python"), *[x for x in PLAIN if x[0] != "src/b.py"]])


def test_links_are_followed_once(spark, root):
    got = rows(files.walked_files(spark, str(root), follow=True))
    assert [x for x in got if x[1] != "o"] == PLAIN and [x[1] for x in got if x[1] == "o"] == ["o"]


def test_targets_and_errors(spark, root):
    assert rows(files.walked_files(spark, str(root), target="src")) == PLAIN[1:]
    assert rows(files.walked_files(spark, str(root), target="a.py")) == PLAIN[:1]
    assert rows(files.walked_files(spark, str(root), patterns=("src/deep/*",))) == PLAIN[:2]
    for bad in ("../x", "/etc"):
        with pytest.raises(ValueError):
            files.walked_files(spark, str(root), target=bad)
    with pytest.raises(Exception, match="FileNotFoundError|nothing"):
        files.walked_files(spark, str(root / "nothing")).count()
    os.chmod(root / "src", 0o755)
