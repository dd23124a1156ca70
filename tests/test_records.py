"""CSV values that span lines, read in splits."""

import csv
import io
import random

import pytest

from braidwork.sources import readers, records


def plain(line, inside, sep):
    """One character after the other."""
    state = "in" if inside else "start"
    i = 0
    while i < len(line):
        c = line[i]
        if state == "in":
            if c == '"' and line[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                state = "rest"
        elif c == sep:
            state = "start"
        elif state == "start" and c == '"':
            state = "in"
        else:
            state = "rest"
        i += 1
    return state == "in"


def test_what_a_line_leaves_open():
    r = random.Random(1)
    for _ in range(5000):
        line = "".join(r.choice('a",,""b ') for _ in range(r.randint(0, 12)))
        for inside in (False, True):
            assert records.ends_inside(line.encode(), inside, b",") == plain(line, inside, ","), (line, inside)


@pytest.mark.parametrize("block", ["90b", "400b", "128m"])
@pytest.mark.parametrize("charset", ["utf-8", "latin-1"])
def test_values_over_lines_in_splits(spark, tmp_path, block, charset):
    r = random.Random(2)
    value = lambda: "".join(r.choice(['a', 'é', '"', ",", "\n", "\r\n", " ", "x", '""']) for _ in range(r.randint(0, 30)))
    rows = [(str(i), value(), r.choice(["plain", 'inch 5" disk', "", "NA", value()])) for i in range(70)]
    (tmp_path / "d").mkdir()
    for n, part in enumerate((rows[:40], rows[40:])):
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator="\n")
        w.writerows([("id", "note", "other\nname"), *part])
        (tmp_path / "d" / f"{n}.csv").write_bytes(out.getvalue().encode(charset))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        df = readers.read_csv(spark, str(tmp_path / "d"), ",", charset)
        assert df.columns == ["id", "note", "other\nname"]
        got = sorted(map(tuple, df.collect()))
        tasks = records.split(spark, str(tmp_path / "d"), ",", "UTF-8" if charset == "utf-8" else "ISO-8859-1")[0].rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    null = lambda v: None if v in readers.NULL_TOKENS else v
    assert got == sorted((int(i), null(a), null(b)) for i, a, b in rows)
    assert tasks > (2 if block == "400b" else 1)


def test_one_stray_quote(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,size\n1,5" disk\n2,"a\nb"\n3,c\n')
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "s.csv")).collect())) == [(1, '5" disk'), (2, "a\nb"), (3, "c")]
