"""The data source of document folders."""

import os

import pytest
from pyspark.sql import functions as F

from quire.sources import files, folders


@pytest.fixture
def root(tmp_path):
    for name in ["README.md", "docs/a.md", "docs/x/b.MD", "docs/x/y/c.markdown", "docs/.h/c.md", "node_modules/q.md", "docs/node_modules/n.md", "docs/z.txt", ".hidden.md"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "docs/large.md").write_text("x" * 5000)
    return tmp_path


def load(spark, root, **options):
    folders.register(spark)
    return spark.read.format("quire_documents").options(**options).load(str(root))


WANT = {"README.md", "docs/a.md", "docs/x/b.MD", "docs/x/y/c.markdown", "docs/large.md"}


@pytest.mark.parametrize("enough", [1, 2, 64])
def test_lists_what_can_be_used(spark, root, enough):
    rows = load(spark, root, partitions=str(enough)).collect()
    assert {r.rel_path for r in rows} == WANT and len(rows) == len(WANT)
    assert {r.rel_path: bytes(r.content) for r in rows} == {p: (root / p).read_bytes() for p in WANT}
    assert all(r.length == os.path.getsize(root / r.rel_path) and abs(r.modified.timestamp() - os.path.getmtime(root / r.rel_path)) < 0.001 for r in rows)


def test_many_links_cost_neither_plan_nor_tasks(spark, root):
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    alone = size(files.scan_folder(spark, str(root)))
    (root / "links").mkdir()
    for i in range(10_000):
        os.symlink(root / "README.md", root / f"links/{i}.md")
    os.symlink(root / "docs", root / "linked")
    documents = files.scan_folder(spark, str(root))
    assert abs(size(documents) - alone) < alone / 10
    assert {r.rel_path for r in documents.collect()} == WANT


def test_size_and_place_reach_the_listing(spark, root):
    listing = folders.Listing(str(root), most_bytes=100, below="docs/x/")
    assert not listing.enters("other") and listing.enters("docs") and listing.enters("docs/x/y") and not listing.enters("docs/xy")
    reader = folders.FolderReader(listing, True, 64)
    assert {row[0] for part in reader.partitions() for row in reader.read(part)} == {"docs/x/b.MD", "docs/x/y/c.markdown"}
    rows = load(spark, root, most_bytes="100")
    assert {r.rel_path for r in rows.collect()} == WANT - {"docs/large.md"}
    assert {r.rel_path for r in rows.filter(F.col("rel_path").startswith("docs/")).collect()} == WANT - {"docs/large.md", "README.md"}
    assert {r.rel_path for r in rows.collect()} == WANT - {"docs/large.md"}  # a filter leaves nothing behind
    assert load(spark, root, below="nowhere/").count() == 0


def test_content_is_left_out_on_request_and_lost_files_are_skipped(spark, root):
    assert {r.content for r in load(spark, root, content="false").collect()} == {None}
    listing = folders.Listing(str(root))
    found = folders.Found("gone.md", "gone.md", 1, 1)
    assert listing.read(found) is None
    os.symlink(root / "README.md", root / "late.md")
    assert listing.read(folders.Found("late.md", "late.md", 1, 1)) is None


def test_other_stores_are_told_apart():
    assert [folders.local_folder(p) for p in ("/a", "file:/a", "file:///a", "s3://a/b", "viewfs://c/in")] == ["/a", "/a", "/a", None, None]
