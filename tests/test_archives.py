"""ZIP archives: members on many tasks, damaged ones apart."""

import zipfile

import pytest

from candela.sources import archives, landing


def test_members_of_one_archive_are_read_by_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(12):
            z.writestr(f"d/m{k}.ndjson", "".join(f'{{"k": {k}, "n": {n}}}\n' for n in range(k)))
        z.writestr("d/bad.ndjson", b'{"k": 1}\n\xff\xfe\n{"k": \n')
        z.writestr("readme.txt", "no data")
        z.mkdir("d/empty")
    good, bad = archives.archive_lines(spark, str(tmp_path), ".ndjson", pack_bytes=40)
    assert good.rdd.getNumPartitions() >= 6
    assert good.where("member like 'd/m%'").count() == sum(range(12))
    assert [(r.member, r.line, r.problem) for r in bad.collect()] == [("d/bad.ndjson", 1, "line is not UTF-8")]
    rows, broken = landing.parse_lines(good, "k INT, n INT")
    assert rows.count() == sum(range(12)) + 1 and [r.text for r in broken.collect()] == ['{"k": ']
    assert archives.archive_lines(spark, str(tmp_path))[0].where("member = 'readme.txt'").count() == 1


def test_a_damaged_member_is_told_and_others_are_read(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one", "x\n" * 5000)
        z.writestr("two", "y\n" * 3)
    raw = bytearray(path.read_bytes())
    raw[200] = ord("z")  # in the first member's stored bytes
    path.write_bytes(raw)
    good, bad = archives.archive_lines(spark, f"file://{path}")
    assert good.where("member = 'two'").count() == 3
    told = bad.collect()
    assert [(r.member, r.problem) for r in told] == [("one", "member can't be read on: BadZipFile")]


def test_no_archive_and_no_folder(spark, tmp_path):
    good, bad = archives.archive_lines(spark, str(tmp_path))
    assert good.count() == bad.count() == 0
    with pytest.raises(Exception, match="nowhere"):
        archives.archive_lines(spark, f"{tmp_path}/nowhere")[0].count()


def test_written_archives_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{k % 2}", k, f"line {k}") for k in range(25)], "archive string, k int, text string")
    made = archives.write_archives(rows, "archive", "k", "text", str(tmp_path), per_member=4).collect()
    assert len(made) == 4 + 3
    good, _ = archives.archive_lines(spark, str(tmp_path), pack_bytes=1)
    assert sorted((r.member, r.line, r.text) for r in good.where("path like '%a1.zip'").collect()) == [(f"part-{j // 4:05d}.ndjson", j % 4, f"line {2 * j + 1}") for j in range(12)]
