"""CSV records of split files, against a reader that goes through each file from its start."""

import csv
import io
import random

import pytest

from tracegrid.sources import flat
from tracegrid.sources.records import csv_records

CELLS = ["a", "", "plain text", 'an 8" pipe', 'x""y', "two\nlines", 'a "quoted"\n\nend', "c,d", "\n", '"', 'said ""\n', "tail "]


def cell(rng):
    value = rng.choice(CELLS)
    # A quote inside a plain cell opens nothing.
    return value if value in ("a", "", "plain text", 'an 8" pipe', 'x""y', "tail ") else '"' + value.replace('"', '""') + '"'


def make(folder, seed, files, ends="\n"):
    rng = random.Random(seed)
    want = []
    for f in range(files):
        lines = ["title", "", "id,note,more"]
        for r in range(rng.randint(0, 25)):
            lines.append(",".join([f"{f}-{r}", cell(rng), cell(rng)]))
            if rng.random() < 0.1:
                lines.append("")
        text = "\n".join(lines) + ("\n" if rng.random() < 0.7 else "")
        (folder / f"f{f:03}.csv").write_bytes(text.replace("\n", ends).encode())
        records = [r for r in csv.reader(io.StringIO(text.replace("\n", "\n"))) if r]
        want += [tuple(c or None for c in r) for r in records[2:]]
    return want


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,ends", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_equals_a_reader_from_the_start(spark, tmp_path, small_blocks, seed, ends):
    want = make(tmp_path, seed, 12, ends)
    path = str(tmp_path / "*.csv")
    lines = spark.read.text(path)
    assert lines.rdd.getNumPartitions() > 12
    got = flat.read_flat(spark, path, header_row=3, position="n")
    assert got.columns == ["n", "id", "note", "more"]
    rows = sorted(map(tuple, got.collect()))
    assert [r[0] for r in rows] == list(range(1, len(want) + 1))
    assert [r[1:] for r in rows] == want


def test_many_files_in_order(spark, tmp_path):
    want = make(tmp_path, 9, 200)
    rows = sorted(map(tuple, flat.read_flat(spark, str(tmp_path / "*.csv"), header_row=3, position="n").collect()))
    assert [r[0] for r in rows] == list(range(1, len(want) + 1))
    assert [r[1:] for r in rows] == want


def test_a_block_inside_one_record(spark, tmp_path, small_blocks):
    """A record longer than many blocks, and one that never ends."""
    long = "line\n" * 200
    (tmp_path / "a.csv").write_text(f'id,note\n1,"{long}"\n2,x\n')
    (tmp_path / "b.csv").write_text('id,note\n3,"open\n4,x\n')
    records = {r.position: r.record for r in csv_records(spark, str(tmp_path / "*.csv"), 1).collect()}
    assert records == {1: f'1,"{long}"', 2: "2,x", 3: '3,"open\n4,x'}


def test_positions_of_parquet_rows(spark, tmp_path):
    for i in range(3):
        spark.range(i * 100, i * 100 + 40 + i).write.parquet(str(tmp_path / f"t/p={i}"))
    df = flat.read_flat(spark, str(tmp_path / "t"), position="n")
    got = sorted(map(tuple, df.select("n", "id").collect()))
    assert [n for n, _ in got] == list(range(1, 124))
    files = spark.read.parquet(str(tmp_path / "t")).selectExpr("_metadata.file_path f", "_metadata.row_index i", "id").collect()
    assert [i for _, i in got] == [r.id for r in sorted(files)]


def test_name_taken(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,x\n1,2\n")
    with pytest.raises(ValueError, match="already"):
        flat.read_flat(spark, str(tmp_path / "a.csv"), position="n")
    assert flat.read_flat(spark, str(tmp_path / "a.csv"), position="k").collect() == [(1, "1", "2")]
