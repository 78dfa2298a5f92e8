"""Folders of very many files: tasks list, read and delete them, not the driver."""

import pytest

from lzseq.functions import session
from lzseq.sources import readers


def test_driver_holds_no_list_of_files(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    for k in range(300):
        (folder / f"{k}.lz").write_bytes(readers.to_vbyte([65 + k % 26, 0, 0, 3]))
    for name in ("_SUCCESS", ".hidden.lz"):
        (folder / name).write_bytes(b"\x81")
    (folder / "empty.lz").write_bytes(b"")
    (folder / "other.txt").write_bytes(readers.to_vbyte([66, 0]))
    rows = readers.decoded_files(spark, str(folder), "vbyte", "*.lz")
    assert not rows.inputFiles()  # no file index, which the driver would hold
    assert sorted((r.file, r.text) for r in rows.collect()) == sorted((f"file:{folder}/{k}.lz", chr(65 + k % 26) * 4) for k in range(300))
    assert readers.decoded_files(spark, str(folder), "vbyte").count() == 301
    plain = readers.decoded_files(spark, f"{folder}/1*.lz", "vbyte")  # a pattern is Spark's to find
    assert plain.inputFiles() and {r.text for r in plain.collect()} <= {c * 4 for c in map(chr, range(65, 91))}
    assert readers.parse_files(spark, str(folder), "vbyte", "*.lz").count() == 600
    (folder / "none").mkdir()
    assert readers.decoded_files(spark, str(folder / "none"), "vbyte").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.decoded_files(spark, str(tmp_path / "nowhere"), "vbyte").count()
    session.remove_by_task(spark, str(folder))
    session.remove_by_task(spark, str(folder))
    assert not folder.exists()
