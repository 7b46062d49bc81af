"""Image files: strips, packing, byte orders, kinds that are skipped, files at fault, and the way back."""

import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException

from cardioframe.operators import images
from cardioframe.sources import tiff


def packed(data):
    """Run lengths of bytes, taken one row of literals and runs at a time."""
    out, at = b"", 0
    while at < len(data):
        run = 1
        while run < 128 and data[at : at + run + 1] == data[at : at + 1] * (run + 1):
            run += 1
        if run > 1:
            out += bytes([257 - run]) + data[at : at + 1]
        else:
            out += bytes([0]) + data[at : at + 1]
        at += run
    return out + b"\x80"


def image(pixels, order="<", rows=5, packing=1, samples=1, kind=1, following=0):
    data = [pixels[k : k + rows].astype(pixels.dtype.newbyteorder(order)).tobytes() for k in range(0, len(pixels), rows)]
    data = [packed(d) if packing == 32773 else d for d in data]
    at = np.cumsum([8, *map(len, data)]).tolist()
    tags = [(256, 4, [pixels.shape[1]]), (257, 3, [len(pixels)]), (258, 3, [8 * pixels.dtype.itemsize]), (259, 3, [packing]), (273, 4, at[:-1]), (277, 3, [samples]), (278, 3, [rows]), (279, 4, [len(d) for d in data]), (339, 3, [kind])]
    head, extra, base = b"", b"", at[-1] + 2 + 12 * len(tags) + 4
    for tag, code, values in tags:
        raw = struct.pack(f"{order}{len(values)}{'HI'[code == 4]}", *values)
        head += struct.pack(order + "HHI", tag, code, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", base + len(extra)))
        extra += raw if len(raw) > 4 else b""
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at[-1]) + b"".join(data) + struct.pack(order + "H", len(tags)) + head + struct.pack(order + "I", following) + extra


RNG = np.random.default_rng(1)
GOOD = {
    "plain.tiff": image(RNG.integers(0, 255, (23, 40)).astype(np.uint8)),
    "big_end.tiff": image(RNG.integers(0, 60000, (9, 17)).astype(np.uint16), ">"),
    "packed.tif": image(np.repeat(RNG.integers(0, 3, (12, 6)), 4, axis=1).astype(np.uint8), packing=32773),
    "floats.tiff": image(RNG.normal(size=(16, 16)).astype(np.float32), kind=3, rows=16),
    "tall.tiff": image(RNG.integers(-9, 9, (50, 3)).astype(np.int16), kind=2, rows=7),
}
SKIPPED = {"rgb.tiff": image(RNG.integers(0, 255, (6, 12)).astype(np.uint8), samples=3), "pages.tiff": image(RNG.integers(0, 255, (6, 12)).astype(np.uint8), following=8)}
FAULTY = {"cut.tiff": GOOD["plain.tiff"][:300], "text.tiff": b"no image at all", "empty.tiff": b"", "squeezed.tiff": image(RNG.integers(0, 9, (6, 6)).astype(np.uint8), packing=5)}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    for name, data in (GOOD | SKIPPED).items():
        (tmp_path / ("deep" if name.startswith("p") else "") / name).write_bytes(data)
    (tmp_path / "notes.csv").write_text("x")
    return tmp_path


def pixels_of(data):
    import io

    f = io.BytesIO(data)
    tags = tiff.directory(f, len(data))
    return np.concatenate([p for _, p in tiff.strips(f, tags, 0, 1)])


def read(spark, folder, **how):
    out = {}
    for r in images.to_columns(tiff.image_tiles(spark, str(folder), side=16, **how), ["file"], 16).orderBy("t").collect():
        out.setdefault(r["file"], []).append(r["col"])
    return {k: np.array(v).T for k, v in out.items()}


@pytest.mark.parametrize("split", [1 << 20, 100])
def test_images_come_back_whole(spark, folder, split):
    got = read(spark, folder, split=split)
    assert set(got) == set(GOOD)
    assert all(np.array_equal(got[k], pixels_of(v)) for k, v in GOOD.items())
    assert got["big_end.tiff"].max() > 255 and got["tall.tiff"].min() < 0


def test_a_file_of_several_strips_is_read_by_several_tasks(folder):
    reader = tiff.Reader({"path": str(folder), "split": "200"})
    parts = [p for p in reader.partitions() if p.files and p.files[0][0].endswith("plain.tiff")]
    rows = [sorted({y for b in reader.read(p) for y in b.column(4).to_pylist()}) for p in parts]
    assert len(parts) > 3 and sorted(y for r in rows for y in r) == [0, 5, 10, 15, 20]


def test_small_files_share_a_task(folder):
    assert len(tiff.Reader({"path": str(folder)}).partitions()) == 1


def test_names_are_handed_down(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = tiff.pieces(spark, str(folder), side=16).where("file = 'packed.tif'")
        assert {r["file"] for r in df.collect()} == {"packed.tif"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = tiff.NamedReader({"path": str(folder), "split": "200"})
    assert list(reader.pushFilters([tiff.EqualTo(("file",), "tall.tiff"), tiff.EqualTo(("ty",), 0)])) == [tiff.EqualTo(("ty",), 0)]
    assert {f[0].rsplit("/", 1)[1] for p in reader.partitions() for f in p.files} == {"tall.tiff"}


@pytest.mark.parametrize("name", sorted(FAULTY))
def test_files_at_fault_are_named(spark, folder, name):
    (folder / name).write_bytes(FAULTY[name])
    with pytest.raises(PySparkException, match=name):
        tiff.pieces(spark, str(folder)).collect()
    bad = tiff.pieces(spark, str(folder), broken="report").where("problem is not null").collect()
    assert {r["file"] for r in bad} == {name} and all(r["problem"] for r in bad)
    assert set(read(spark, folder, broken="report")) >= set(GOOD)


def test_an_empty_folder_has_no_images(spark, tmp_path):
    assert tiff.image_tiles(spark, str(tmp_path)).count() == 0


def test_written_images_are_read_again(spark, tmp_path):
    m = RNG.normal(size=(130, 20)).astype(np.float32)
    df = spark.createDataFrame([("a.cxd", 2, 31, t, m[:, t].tolist()) for t in range(20)], "recording string, peak_no int, xpos int, t int, col array<float>")
    (row,) = tiff.write_images(df, str(tmp_path / "out")).collect()
    assert row["file"] == "a.cxd_peak_2_at Xpos_31.tiff" and row["bytes"] == (tmp_path / "out" / row["file"]).stat().st_size
    assert np.array_equal(read(spark, tmp_path)[row["file"]], m)
