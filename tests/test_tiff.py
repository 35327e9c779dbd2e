import struct
import zlib

import numpy as np
import pytest

from livgrid.sources import tiff

VALUES = np.array([[1.5, -2.25, 3.0], [4.0, -9999.0, 6.5], [7.0, 8.0, 9.0]], np.float32)


def write(values, order, compression, predictor, rows):
    blocks = []
    for y in range(0, len(values), rows):
        part = values[y : y + rows]
        if predictor == 3:
            planes = part.astype(">f4").view(np.uint8).reshape(len(part), -1, 4).transpose(0, 2, 1).reshape(len(part), -1)
            raw = np.diff(planes, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).astype(np.uint8).tobytes()
        elif predictor == 2:
            raw = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype)).astype(part.dtype.newbyteorder(order)).tobytes()
        else:
            raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
        blocks.append(zlib.compress(raw) if compression == 8 else raw)
    head, at, offsets = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 42), 8, []
    body = b""
    for b in blocks:
        offsets.append(at + len(body))
        body += b
    extra_at = at + len(body)
    extra = b""
    entries = []

    def add(tag, kind, values, code):
        nonlocal extra
        data = values if kind == 2 else struct.pack(f"{order}{len(values)}{code}", *values)
        if len(data) <= 4:
            where = data.ljust(4, b"\0")
        else:
            where = struct.pack(order + "I", extra_at + len(extra))
            extra += data
        entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + where)

    f = 3 if values.dtype.kind == "f" else 1
    for tag, kind, v, code in [(256, 3, [values.shape[1]], "H"), (257, 3, [len(values)], "H"), (258, 3, [values.dtype.itemsize * 8], "H"), (259, 3, [compression], "H"), (273, 4, offsets, "I"), (277, 3, [1], "H"), (278, 3, [rows], "H"), (279, 4, [len(b) for b in blocks], "I"),
                               (317, 3, [predictor], "H"), (339, 3, [f], "H"), (33550, 12, [50.0, 50.0, 0.0], "d"), (33922, 12, [0.0, 0.0, 0.0, 1000.0, 2000.0, 0.0], "d"), (42113, 2, b"-9999\0", "s")]:
        add(tag, kind, v, code)
    ifd = struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
    return head + struct.pack(order + "I", extra_at + len(extra)) + body + extra + ifd


@pytest.mark.parametrize(("order", "compression", "predictor", "rows"), [("<", 1, 1, 3), (">", 1, 1, 2), ("<", 8, 1, 2), ("<", 8, 3, 2), (">", 8, 3, 3)])
def test_floats(order, compression, predictor, rows):
    r = tiff.read(write(VALUES, order, compression, predictor, rows))
    assert np.array_equal(r.values, VALUES) and (r.left, r.top, r.cell, r.nodata) == (1000.0, 2000.0, (50.0, 50.0), -9999.0)


def test_integers_and_damage():
    whole = np.array([[1, 200, 3], [4, 5, 60000]], np.uint16)
    assert np.array_equal(tiff.read(write(whole, "<", 8, 2, 1)).values, whole)
    with pytest.raises(ValueError):
        tiff.read(b"PNG?" * 10)
    with pytest.raises(ValueError):
        tiff.read(write(VALUES, "<", 5, 1, 3))


def test_cells(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(write(VALUES, "<", 8, 3, 2))
    rows = {(r["row"], r["col"]): r for r in tiff.cells(spark, f"file://{tmp_path}/a.tif").collect()}
    assert len(rows) == 9 and rows[1, 1]["value"] is None and rows[2, 0]["value"] == 7.0 and (rows[2, 0]["x"], rows[2, 0]["y"]) == (1025.0, 1875.0)
