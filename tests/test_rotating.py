"""A log that grows, rotates and is read by a query that stops and starts again: every line once."""

import json
import os
import random

import pytest

from tastemill.sources import rotating as ro
from tastemill.streaming import streams as st


class Logger:
    """Appends lines to ``data.json`` and renames files at a size limit, as the service's logger does."""

    def __init__(self, folder, limit, keep=50):
        self.folder, self.limit, self.keep, self.lines = folder, limit, keep, 0
        os.makedirs(folder, exist_ok=True)

    def path(self, n=0):
        return os.path.join(self.folder, "data.json" + (f".{n}" if n else ""))

    def rotate(self):
        for n in range(self.keep, -1, -1):
            if os.path.exists(self.path(n)):
                os.rename(self.path(n), self.path(n + 1))

    def write(self, count, text="é"):
        for _ in range(count):
            if os.path.exists(self.path()) and os.path.getsize(self.path()) > self.limit:
                self.rotate()
            with open(self.path(), "a", encoding="utf-8") as out:
                out.write(json.dumps({"n": self.lines, "text": text * (self.lines % 7)}, ensure_ascii=False) + "\n")
            self.lines += 1


def lines_of(spark, folder, out, size=64):
    """One more run of the same query; all lines it has written so far."""
    spark.dataSource.register(ro.RotatingLog)
    stream = spark.readStream.format("rotating_log").option("prefix", "data.json").option("range", size).load(folder)
    st.run_available(stream, f"{out}/data", f"{out}/checkpoint")
    return sorted(json.loads(r["line"])["n"] for r in spark.read.schema(ro.SCHEMA).parquet(f"{out}/data").collect())


def test_every_line_once_over_appends_rotations_and_restarts(spark, tmp_path):
    log = Logger(str(tmp_path / "log"), 700)
    for count in (3, 0, 40, 1, 90):
        log.write(count)
        assert lines_of(spark, log.folder, str(tmp_path / "out")) == list(range(log.lines))
    assert os.path.exists(log.path(3))
    log.rotate()  # renamed, nothing new
    assert lines_of(spark, log.folder, str(tmp_path / "out")) == list(range(log.lines))


def test_an_unfinished_line_waits_for_its_rest(spark, tmp_path):
    log = Logger(str(tmp_path / "log"), 10_000)
    log.write(2)
    with open(log.path(), "a") as out:
        out.write('{"n": 2, "te')
    assert lines_of(spark, log.folder, str(tmp_path / "out")) == [0, 1]
    with open(log.path(), "a") as out:
        out.write('xt": "x"}\n')
    assert lines_of(spark, log.folder, str(tmp_path / "out")) == [0, 1, 2]


def test_empty_folder_then_a_first_line(spark, tmp_path):
    log = Logger(str(tmp_path / "log"), 100)
    spark.dataSource.register(ro.RotatingLog)
    reader = ro.RotatingReader({"path": log.folder})
    assert reader.latestOffset() == reader.initialOffset()
    assert ro.RotatingReader({"path": str(tmp_path / "none")}).latestOffset() == reader.initialOffset()
    log.write(1)
    assert reader.latestOffset() != reader.initialOffset()


@pytest.mark.parametrize("size", [1, 2, 5, 17, 64, 1000, 1 << 20])
def test_ranges_cut_at_any_byte_give_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(ro, "PIECE", 13)
    log = Logger(str(tmp_path / "log"), 1 << 30)
    log.write(25)
    with open(log.path(), "ab") as out:
        out.write(b"\n\r\nlong " + b"x" * 90 + b"\nno end")
    reader = ro.RotatingReader({"path": log.folder, "range": size})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    got = [(a, t) for p in parts for b in reader.read(p) for a, t in zip(b["at"].to_pylist(), b["line"].to_pylist(), strict=True)]
    data = open(log.path(), "rb").read()
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line.rstrip(b"\r").decode()))
        at += len(line) + 1
    assert got == want


def test_a_file_renamed_after_planning_is_found_and_a_lost_one_fails(tmp_path):
    log = Logger(str(tmp_path / "log"), 1 << 30)
    log.write(5)
    reader = ro.RotatingReader({"path": log.folder, "prefix": "data.json"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    log.rotate()
    log.write(2)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 5
    end = reader.latestOffset()
    os.remove(log.path(1))
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    with pytest.raises(FileNotFoundError):
        reader.partitions(reader.initialOffset(), end)


def test_files_that_begin_alike_are_refused(tmp_path):
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text("same\nother\n")
    with pytest.raises(ValueError):
        ro.log_files(str(tmp_path), "")


def test_random_histories(tmp_path):
    rng = random.Random(1)
    log = Logger(str(tmp_path / "log"), 300)
    reader = ro.RotatingReader({"path": log.folder, "prefix": "data.json", "range": 50})
    offset, seen = reader.initialOffset(), []
    for _ in range(30):
        log.write(rng.randrange(6))
        end = reader.latestOffset()
        for part in reader.partitions(offset, end):
            seen += [json.loads(t)["n"] for b in reader.read(part) for t in b["line"].to_pylist()]
        offset = end
    assert sorted(seen) == list(range(log.lines))
