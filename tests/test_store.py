"""The version log and the audit of a store."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import audit
from tessera.sources import store


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "s")
    table = lambda n: {"t": spark.range(n)}
    assert store.current_version(spark, root) is None and store.read_table(spark, root, "t") is None
    store.write_tables(table(1), root, "a", None)
    with pytest.raises(store.Conflict):
        store.write_tables(table(2), root, "b", None)  # built on nothing, though there is a version now
    store.write_tables(table(3), root, "b", "a")
    with pytest.raises(ValueError, match="committed"):
        store.write_tables(table(4), root, "a")
    assert store.version_log(spark, root) == ["a", "b"] and store.read_table(spark, root, "t").count() == 3
    assert store.read_table(spark, root, "t", "a").count() == 1 and store.read_table(spark, root, "t", "x") is None
    assert store.create(spark, f"{root}/_versions/000002.json", "{}") and not store.create(spark, f"{root}/_versions/000002.json", "{}")


def test_two_writers_that_read_the_same_log(spark, tmp_path, monkeypatch):
    """Both have looked before either commits: the second finds the entry taken, and its tables don't count."""
    root = str(tmp_path / "s")
    store.write_tables({"t": spark.range(1)}, root, "a", None)
    plain = store.create

    def late(spark_, path, text):
        monkeypatch.setattr(store, "create", plain)
        store.write_tables({"t": spark.range(5)}, root, "other", "a")
        return plain(spark_, path, text)

    monkeypatch.setattr(store, "create", late)
    with pytest.raises(store.Conflict):
        store.write_tables({"t": spark.range(9)}, root, "mine", "a")
    assert store.version_log(spark, root) == ["a", "other"] and store.read_table(spark, root, "t").count() == 5


def test_a_failed_write_can_be_tried_again(spark, tmp_path):
    root = str(tmp_path / "s")
    store.write_tables({"t": spark.range(1), "u": spark.range(1)}, root, "a", None)
    broken = spark.range(3).select(F.raise_error(F.lit("stopped")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stopped"):
        store.write_tables({"t": spark.range(7), "u": broken}, root, "b", "a")
    assert store.current_version(spark, root) == "a" and store.read_table(spark, root, "t").count() == 1
    store.write_tables({"t": spark.range(7), "u": spark.range(8)}, root, "b", "a")
    assert [store.read_table(spark, root, x).count() for x in "tu"] == [7, 8]


def test_each_planted_fault_is_found(spark, tmp_path):
    out = str(tmp_path / "o")
    sites = ["good", "site 2", "bare", "stray", "grid", "lost", "left"]
    rows = [(s, i, f"{s}/patches#{i}", [1.0, 2.0]) for s in sites for i in range(3)]
    store.write_cells(spark.createDataFrame(rows, "site_id string, cell_id bigint, patch_ref string, cls array<float>"), f"{out}/cells")
    ids = {"bare": range(2), "stray": range(4)}
    patches = [(s, i, r, 0, [1.0, float(r)]) for s in sites if s != "lost" for i in ids.get(s, range(3)) for r in range(1 if (s, i) == ("grid", 1) else 2)]
    store.write_patches(spark.createDataFrame(patches, "site_id string, cell_id bigint, prow int, pcol int, vec array<float>"), f"{out}/patches")
    meta = [(s, 3, 2, [2, 1], 8.0) for s in sites if s != "left"]
    store.write_site_meta(spark.createDataFrame(meta, "site_id string, n_cells bigint, embed_dim int, patch_grid array<int>, cell_ground_m double"), f"{out}/meta")
    (tmp_path / "o/cells/stranger.parquet").write_bytes(b"x")
    (tmp_path / "o/runs").mkdir()
    (tmp_path / "o/runs/r.json").write_text("{}")
    loose = {r["path"]: r["problem"] for r in audit.unowned(audit.store_files(spark, out)).collect()}
    assert loose.pop("cells/stranger.parquet") == "in no part of the store"
    assert len(loose) == 2 and all("site_id=left/" in p and w == "of a site without metadata" for p, w in loose.items())
    (tmp_path / "o/cells/stranger.parquet").unlink()
    got = {r["site_id"]: r for r in audit.audited(spark, out).collect()}
    assert got["good"]["ok"] and got["site 2"]["ok"] and got["good"]["files"] == 3 and got["good"]["bytes"] > 0
    has = lambda s, text: any(text in p for p in got[s]["problems"])
    assert has("bare", "1 cells without patches")
    assert has("stray", "1 cells of patches are unknown") and has("grid", "1 cells' patches aren't the stated grid")
    assert has("lost", "patches has no file") and has("lost", "no patches") and has("left", "meta has no file") and has("left", "no metadata")
    assert audit.audited(spark, str(tmp_path / "nothing")).count() == 0
