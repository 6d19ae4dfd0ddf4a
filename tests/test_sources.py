import json
import struct
import zlib

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from cytogrid.operators.features import arcsinh_normalize
from cytogrid.operators.morphology import cell_morphology
from cytogrid.plans.workflow import StudyTables, Workflow
from cytogrid.session import cut_lineage, shared_dir
from cytogrid.sources import blosc, chunked_images, metadata, tables


def write_array(folder, values, chunk, compress=True):
    folder.mkdir(parents=True)
    rows, cols = chunk
    for i in range(0, values.shape[0], rows):
        for j in range(0, values.shape[1], cols):
            block = np.zeros(chunk, values.dtype)
            part = values[i:i + rows, j:j + cols]
            block[: part.shape[0], : part.shape[1]] = part
            data = zlib.compress(block.tobytes()) if compress else block.tobytes()
            (folder / f"{i // rows}.{j // cols}").write_bytes(data)
    (folder / ".zarray").write_text(json.dumps({
        "shape": list(values.shape), "chunks": list(chunk), "dtype": values.dtype.str, "order": "C",
        "compressor": {"id": "zlib"} if compress else None}))


@pytest.fixture(scope="module")
def image_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(1)
    write_array(root / "s1_a" / "CD3", rng.integers(0, 99, (5, 7)).astype("<u2"), (3, 4))
    write_array(root / "s1_a" / "K8.18", rng.random((5, 7)), (5, 7), compress=False)
    mask = np.zeros((5, 7), "<i4")
    mask[1:3, 1:6] = 4
    write_array(root / "s1_a" / "seg_mask", mask, (3, 4))
    write_array(root / "s1_a" / "broken", rng.random((5, 7)), (5, 7))
    (root / "s1_a" / "broken" / "0.0").write_bytes(b"junk")
    return root, mask


def test_tiles_and_mask(spark, image_root):
    root, mask = image_root
    tiles = chunked_images.read_tiles(spark, str(root))
    good = chunked_images.channel_tiles(tiles)
    assert {r.channel for r in good.select("channel").distinct().collect()} == {"CD3", "K8.18"}
    assert [r.channel for r in chunked_images.unreadable(tiles).collect()] == ["broken"]
    pixels = chunked_images.to_pixels(chunked_images.channel_tiles(tiles, ["CD3", "none"])).toPandas()
    assert len(pixels) == 35 and set(pixels.row) == set(range(5)) and set(pixels.col) == set(range(7))
    labelled = chunked_images.mask_pixels(tiles)
    assert labelled.count() == (mask > 0).sum()
    shape = cell_morphology(labelled).first()
    assert (shape.region_id, shape.cell_id, shape.area) == ("s1_a", 4, 10)


@pytest.mark.parametrize("codec", ["lz4_raw", "zlib", "zstd", "snappy"])
@pytest.mark.parametrize("split", [True, False])
@pytest.mark.parametrize("size", [0, 8, 1000, 1003, 70_001])
def test_frames_round_trip(codec, split, size):
    data = (np.arange(size) * 7 % 251 // 5).astype("u1").tobytes()
    for width in (1, 2, 8):
        assert blosc.unpack(blosc.pack(data, width, codec, block_size=4096, split=split)) == data


def test_frames_by_hand():
    """A stored frame, and a block of two streams of which one is not compressed."""
    head = lambda flags, width, total, block, size: struct.pack("<BBBBiii", 2, 1, flags, width, total, block, size)
    assert blosc.unpack(head(0x02, 1, 5, 5, 21) + b"abcde") == b"abcde"
    low, high = bytes(range(128)), zlib.compress(b"\1" * 128)
    body = struct.pack("<i", 20) + struct.pack("<i", 128) + low + struct.pack("<i", len(high)) + high
    frame = head(0x01 | 3 << 5, 2, 256, 256, 16 + len(body)) + body
    assert np.frombuffer(blosc.unpack(frame), "<u2").tolist() == [256 + i for i in range(128)]
    with pytest.raises(ValueError, match="bit-shuffled"):
        blosc.unpack(head(0x04 | 1 << 5, 2, 4, 4, 30) + b"\0" * 14)


def header_of(folder, **changes):
    meta = json.loads((folder / ".zarray").read_text()) | changes
    (folder / ".zarray").write_text(json.dumps(meta))


def test_absent_chunks_separators_and_filters(spark, tmp_path):
    values = np.arange(35, dtype="<i4").reshape(5, 7) * 3
    for name in ("gaps", "first_gone", "delta", "scaled", "odd", "none"):
        write_array(tmp_path / "r" / name, values, (3, 4))
    header_of(tmp_path / "r" / "gaps", fill_value=-5)
    (tmp_path / "r" / "gaps" / "1.0").unlink()
    (tmp_path / "r" / "first_gone" / "0.0").unlink()
    (tmp_path / "r" / "none" / ".zarray").unlink()
    header_of(tmp_path / "r" / "odd", filters=[{"id": "quantize"}])
    chunk = np.zeros((3, 4), "<i4")
    chunk[:] = values[:3, :4]
    steps = np.diff(chunk.ravel(), prepend=0).astype("<i2")
    (tmp_path / "r" / "delta" / "0.0").write_bytes(zlib.compress(steps.tobytes()))
    header_of(tmp_path / "r" / "delta", shape=[3, 4], filters=[{"id": "delta", "dtype": "<i4", "astype": "<i2"}])
    small = (chunk - 1) * 2
    (tmp_path / "r" / "scaled" / "0.0").write_bytes(zlib.compress(small.astype("<i2").tobytes()))
    header_of(tmp_path / "r" / "scaled", shape=[3, 4], dtype="<f8",
              filters=[{"id": "fixedscaleoffset", "scale": 2, "offset": 1, "dtype": "<f8", "astype": "<i2"}])
    nested = tmp_path / "r" / "nested"
    write_array(nested, values, (3, 4))
    header_of(nested, dimension_separator="/")
    for path in list(nested.glob("[0-9].[0-9]")):
        (nested / path.name[0]).mkdir(exist_ok=True)
        path.rename(nested / path.name[0] / path.name[2])
    tiles = chunked_images.read_tiles(spark, str(tmp_path))
    found = {}
    for r in chunked_images.to_pixels(chunked_images.channel_tiles(tiles)).collect():
        found.setdefault(r.channel, {})[r.row, r.col] = r.value
    assert found.keys() == {"gaps", "delta", "scaled", "nested"}
    for name, shape in (("gaps", (5, 7)), ("delta", (3, 4)), ("scaled", (3, 4)), ("nested", (5, 7))):
        want = values[: shape[0], : shape[1]].astype(float)
        if name == "gaps":
            want[3:, :4] = -5
        assert found[name] == dict(np.ndenumerate(want))
    problems = {r.channel: r.error for r in chunked_images.unreadable(tiles).collect()}
    assert problems.keys() == {"odd", "none"} and "quantize" in problems["odd"] and "no array header" in problems["none"]


def test_choosing_the_mask_opens_no_other_array(spark, image_root, monkeypatch):
    root, mask = image_root
    opened = []
    read_header = chunked_images.ImageReader.read_header

    def counting(self, region, channel):
        opened.append((region, channel))
        return read_header(self, region, channel)

    monkeypatch.setattr(chunked_images.ImageReader, "read_header", counting)
    monkeypatch.setattr(chunked_images, "RUN_PIXELS", 24)
    reader = chunked_images.ImageReader({"root": str(root), "channels": json.dumps([chunked_images.MASK])})
    runs = reader.partitions()
    assert opened == [("s1_a", "seg_mask")] and [(r.start, r.stop) for r in runs] == [(0, 2), (2, 4)]
    assert sum(b.num_rows for r in runs for b in reader.read(r)) == 4
    opened.clear()
    pushing = chunked_images.PushingReader({"root": str(root)})
    taken = [EqualTo(("channel",), "CD3"), In(("region_id",), ("s1_a", "none"))]
    rest = EqualTo(("y0",), 0)
    assert list(pushing.pushFilters([*taken, rest])) == [rest]
    pushing.partitions()
    assert opened == [("s1_a", "CD3")]


def test_filters_are_pushed(spark, image_root):
    tiles = chunked_images.read_tiles(spark, str(image_root[0]))
    one = tiles.where("channel = 'CD3' AND region_id IN ('s1_a', 's1_b')")
    assert one.count() == 4 and one.rdd.getNumPartitions() == 1
    assert tiles.where("channel = 'nothing'").count() == 0


def test_written_images_come_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 9, (50, 70)).astype(float)
    values[:20, :20] = 7  # the fill value: no file, but for the first chunk
    rows = [("r1", "A", int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(values) if v != 7]
    pixels = spark.createDataFrame(rows, "region_id string, channel string, row int, col int, value double")
    for separator in ("./"):
        root = str(tmp_path / f"out{ord(separator)}")
        chunked_images.write_image(pixels, root, chunk=(10, 10), dtype="<u2", fill=7, separator=separator)
        back = chunked_images.to_pixels(chunked_images.channel_tiles(chunked_images.read_tiles(spark, root))).collect()
        assert {(r.row, r.col): r.value for r in back} == dict(np.ndenumerate(values))
        files = [p for p in (tmp_path / f"out{ord(separator)}").rglob("*") if p.is_file() and p.name != ".zarray"]
        assert len(files) == 35 - 3


def study(biomarkers, regions):
    return {"study_id": "s1", "root_dir": "/x", "tissue_types": ["Kidney"], "major_phenotypes": "DKD",
            "biomarkers": biomarkers, "functional_biomarkers": [], "selected_acq_ids": regions,
            "diagnosis_dict": {regions[0]: "DKD 2A"}, "cell_type_rename": {"t": "T cell", "b": "B cell"},
            "background": None}


def test_metadata(spark, tmp_path):
    (tmp_path / "m.yaml").write_text(yaml.safe_dump(study(["A", "B.1"], ["s1_a", "s1_b"])))
    studies = metadata.read_studies(spark, str(tmp_path / "*.yaml"))
    row = studies.first()
    assert row.biomarkers == ["A", "B.1"] and row.background is None
    assert {tuple(r) for r in metadata.diagnoses_of(studies).collect()} == {("s1_a", "DKD 2A")}
    assert metadata.renames_of(studies).count() == 2
    assert metadata.regions_of(studies).count() == 2


def test_measured_csv_layout(spark, tmp_path):
    for region in ("s1_a", "s1_b"):
        (tmp_path / region).mkdir()
        (tmp_path / region / f"{region}.cell_data.csv").write_text("Y,CELL_ID,X,Area\n2,1,1.5,9\n")
        (tmp_path / region / f"{region}.cell_types.csv").write_text("id,cluster,name\n1,3,t\n")
        (tmp_path / region / f"{region}.expression.csv").write_text("CELL_ID,K8/18,B.1\n1,0.5,2\n")
    cells = tables.read_cells(spark, str(tmp_path), "measured").orderBy("region_id").collect()
    assert [tuple(r) for r in cells] == [("s1_a", 1, 1.5, 2.0), ("s1_b", 1, 1.5, 2.0)]
    types = tables.read_cell_types(spark, str(tmp_path), "measured").first()
    assert (types.cell_id, types.value, types.cell_type) == (1, 3, "t")
    bm = tables.read_expression(spark, str(tmp_path), ["B.1"], "measured").collect()
    assert {(r.region_id, r.biomarker, r.value) for r in bm} == {("s1_a", "B.1", 2.0), ("s1_b", "B.1", 2.0)}
    with pytest.raises(ValueError):
        tables.read_expression(spark, str(tmp_path), ["nope"], "measured")
    (tmp_path / "s2_a").mkdir()  # another study: other panel, other column order
    (tmp_path / "s2_a" / "s2_a.expression.csv").write_text("B.1,C,CELL_ID\n7,8,1\n")
    other = tables.read_expression(spark, str(tmp_path), ["B.1", "C"], "measured", ["s2_a"]).collect()
    assert {(r.region_id, r.biomarker, r.value) for r in other} == {("s2_a", "B.1", 7.0), ("s2_a", "C", 8.0)}
    same = tables.read_expression(spark, str(tmp_path), ["B.1"], "measured", ["s1_a"]).collect()
    assert {r.region_id for r in same} == {"s1_a"}
    with pytest.raises(Exception):
        tables.read_cells(spark, str(tmp_path / "absent"), "measured").collect()


def test_stage_store(spark, tmp_path):
    store = tables.StageStore(spark, str(tmp_path))
    assert store.load("x") is None
    store.save(spark.range(3), "x")
    store.save(spark.range(2), "x", "append")
    assert store.load("x").count() == 5
    store.save(spark.range(1), "x")
    assert store.load("x").count() == 1
    store.save(spark.range(4).where("false"), "empty")
    assert store.load("empty").count() == 0


def test_a_crash_between_tables_leaves_no_trace(spark, tmp_path, monkeypatch):
    store = tables.StageStore(spark, str(tmp_path))
    store.commit({"cells": spark.range(2), "texts": spark.range(1)}, "append")
    broken = spark.range(1).select((F.col("id") + F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"cells": spark.range(5), "texts": broken}, "append")
    monkeypatch.setattr(tables.StageStore, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.commit({"cells": spark.range(5), "texts": spark.range(5)}, "append")
    monkeypatch.undo()
    again = tables.StageStore(spark, str(tmp_path))
    assert again.load("cells").count() == 2 and again.load("texts").count() == 1
    again.commit({"cells": spark.range(5), "texts": spark.range(5)}, "append")
    assert again.load("cells").count() == 7 and again.load("texts").count() == 6


class FakeSession:
    """A session of a cluster, as far as the shared folder is concerned."""

    def __init__(self, settings):
        self.conf = settings
        self.sparkContext = self
        self.master = "spark://host:7077"
        self.applicationId = "app-1"


def test_shared_folder_is_the_clusters():
    assert shared_dir(FakeSession({"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession({}))


def test_written_tables_keep_types(spark):
    df = spark.range(3).selectExpr("id", "array(id, null) AS a", "map('k', id / 2) AS m")
    assert cut_lineage(df).dtypes == df.dtypes


@pytest.fixture(scope="module")
def study_tables(spark):
    rng = np.random.default_rng(2)
    rows = []
    for region in ("s1_a", "s1_b"):
        for i in range(200):
            x, y = rng.uniform(0, 300, 2)
            kind = "t" if x < 150 else "b"
            rows.append((region, i, float(x), float(y), kind, float(rng.lognormal() + 3 * (x < 150)),
                         float(rng.lognormal() + 3 * (y < 150)), float(rng.uniform(50, 90))))
    base = cut_lineage(spark.createDataFrame(rows, "region_id string, cell_id long, x double, y double, "
                                                   "cell_type string, `A` double, `B.1` double, area double"))
    long = base.select("region_id", "cell_id", "A", "`B.1`").unpivot(
        ["region_id", "cell_id"], ["A", "`B.1`"], "biomarker", "value")
    shapes = base.select("region_id", "cell_id", F.lit(0.3).alias("orientation"), F.col("area").alias("size_area"),
                         F.lit(0.8).alias("shape_circularity"), F.lit(0.6).alias("shape_eccentricity"),
                         F.lit(0.9).alias("shape_solidity"))
    meta = study(["A", "B.1"], ["s1_a", "s1_b"])
    studies = spark.createDataFrame([{**meta, "background": "none"}], metadata.SCHEMA)
    return StudyTables(base.select("region_id", "cell_id", "x", "y"),
                       base.select("region_id", "cell_id", "cell_type"),
                       arcsinh_normalize(long), shapes, studies, ["A", "B.1"])


def counting_backend(folder):
    class Counting:
        """Leaves a file per call; local, so that it travels by value."""

        def reply(self, dialogue):
            import os
            import uuid

            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return "1. **Glomerular tuft**:\n" + str(len(dialogue))

    return Counting()


def test_workflow_and_resume(spark, study_tables, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = tables.StageStore(spark, str(tmp_path / "stages"))
    out = Workflow(study_tables, store, counting_backend(str(calls))).run()
    n = out["texts"].count()
    assert n > 0 and out["annotations"].count() == n and out["pathology"].count() == n
    assert "score" in out["pathology"].columns
    assert out["texts"].where("bm_text IS NULL OR ct_text IS NULL OR seg_text IS NULL").count() == 0
    prompt = out["pathology"].where("region_id = 's1_a'").first().dialogue
    assert "DKD 2A" in prompt[3].content and prompt[2].role == "ai"
    assert out["context"].first().context.startswith("---\nSYSTEM: ")
    before = len(list(calls.iterdir()))
    again = Workflow(study_tables, store, counting_backend(str(calls)), resume=True).run()
    assert len(list(calls.iterdir())) == before
    assert again["annotations"].count() == n and again["texts"].count() == n


def test_small_regions_have_one_file_and_large_ones_several(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 100, raising=False)
    cells = spark.range(0, 340).selectExpr("CASE WHEN id < 40 THEN 'a' ELSE 'b' END AS region_id", "id AS cell_id", "1.5 AS x", "2.5 AS y")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # it would hide the files by putting small parts into one task
    try:
        root = tables.export_native(cells, "cell_data", str(tmp_path / "out"))
    finally:
        spark.conf.unset(merging)
    files = {r: len(list((tmp_path / "out" / "cell_data" / f"region_id={r}").glob("*.csv"))) for r in "ab"}
    assert files["a"] == 1 and 1 < files["b"] <= 3
    assert tables.read_cells(spark, root).count() == 340
