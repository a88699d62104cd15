import random

import pytest

from kindred.sources import records, wide_lines


@pytest.mark.parametrize("encoding, mark", [("UTF-16", b"\xff\xfe"), ("utf-16be", b""), ("utf-32le", b"\xff\xfe\x00\x00")])
def test_one_file_is_split_at_its_line_feeds(spark, tmp_path, encoding, mark):
    rnd = random.Random(1)
    # Letters whose bytes look like a line feed where two of them meet.
    lines = ["".join(rnd.choice("ab|é਀੡愀\u000b\U0001f600") for _ in range(rnd.randrange(30))) for _ in range(300)] + ["", "last"]
    charset = {"UTF-16": "utf-16-le", "utf-16be": "utf-16-be", "utf-32le": "utf-32-le"}[encoding]
    (tmp_path / "in.txt").write_bytes(mark + "\r\n".join(lines[:100]).encode(charset) + "\n".encode(charset) + "\n".join(lines[100:]).encode(charset))
    for split in (1 << 20, 999, 64, 4):  # ranges are read one by one, as tasks would
        reader = wide_lines.Reader({"path": str(tmp_path / "in.txt"), "encoding": encoding, "splitbytes": str(split)})
        rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        assert [r["line"] for r in sorted(rows, key=lambda r: r["seq"])] == lines
    spark.dataSource.register(wide_lines.WideLines)
    df = spark.read.format("wide_lines").option("encoding", encoding).option("splitBytes", 4000).load(str(tmp_path / "in.txt"))
    assert [r.line for r in df.orderBy("seq").collect()] == lines and df.rdd.getNumPartitions() > 1


def test_lines_that_are_no_text_are_set_apart(spark, tmp_path):
    good, bad = "d|1|é|n".encode("utf-16-le"), b"\x00\xd8x\x00"  # half a pair
    (tmp_path / "wide.txt").write_bytes(good + b"\n\x00" + bad + b"\n\x00" + good + b"\n\x00")
    sound, broken = records.sound_lines(records.read_lines(spark, str(tmp_path / "wide.txt"), "utf-16le"))
    assert [r.line for r in sound.collect()] == ["d|1|é|n"] * 2 and [(r.seq, bytes(r.bytes)) for r in broken.collect()] == [(len(good) + 2, bad)]
    (tmp_path / "narrow.txt").write_bytes("naïve €\n".encode("cp1252") + b"\x81\nplain\n")
    sound, broken = records.sound_lines(records.read_lines(spark, str(tmp_path / "narrow.txt"), "cp1252"))
    assert [r.line for r in sound.orderBy("seq").collect()] == ["naïve €", "plain"] and [bytes(r.bytes) for r in broken.collect()] == [b"\x81"]
    with pytest.raises(ValueError, match="other line feeds"):
        records.read_lines(spark, str(tmp_path / "narrow.txt"), "cp037")
