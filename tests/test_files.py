"""FASTQ pairs as a data source, in batch and as a stream; sinks that write formats."""

import gzip

import pytest

from lacuna.sources import fastq_source as Q
from lacuna.sources import sinks
from lacuna.sources import text_formats as T


def text(names, mate="", seq="ACGT"):
    return "".join(f"@{n}{mate}\n{seq}{'ACGT' * (k % 3)}\n+\n{'@FFF' + 'FFFF' * (k % 3)}\n" for k, n in enumerate(names)).encode()


@pytest.fixture
def read(spark):
    Q.register(spark)

    def load(**options):
        return spark.read.format("fastq_pairs").options(**{k: str(v) for k, v in options.items()}).load()

    return load


def test_pairs_in_lockstep(read, tmp_path):
    names = [f"r{k}" for k in range(9000)]
    half = len(names) // 2
    (tmp_path / "lane_R1.fastq.gz").write_bytes(gzip.compress(text(names[:half], "/1")) + gzip.compress(text(names[half:], "/1")))
    (tmp_path / "lane.R2.x").write_bytes(b"")
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "b_R1.fastq").write_bytes(text(["x", "y"], " 1:N"))
    (tmp_path / "two" / "b_R2.fastq").write_bytes(text(["x", "y"], " 2:N", "TTTT"))
    (tmp_path / "one" / "a_R1.fastq.gz").write_bytes(gzip.compress(text(names[:half], "/1")) + gzip.compress(text(names[half:], "/1")))
    (tmp_path / "two" / "a_R2.fastq.gz").write_bytes(gzip.compress(text(names, "/2", "GGGG")))
    (tmp_path / "one" / "_SUCCESS").write_bytes(b"")
    df = read(r1=tmp_path / "one", r2=f"file://{tmp_path}/two")
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 2 and len(rows) == len(names) + 2
    a = sorted((r for r in rows if r.pair == "a_.fastq.gz" or r.pair.startswith("a")), key=lambda r: r.record_no)
    assert [r.name for r in a] == [f"{n}/1" for n in names]
    assert all(r.seq_r1[:4] == "ACGT" and r.seq_r2[:4] == "GGGG" and len(r.seq_r1) == len(r.qual_r2) for r in a)
    capped = read(r1=tmp_path / "one", r2=tmp_path / "two", maxRecords=5).groupBy("pair").count().collect()
    assert sorted(r["count"] for r in capped) == [2, 5]


@pytest.mark.parametrize("step", [1, 7, 50, 1000, 10**6])
def test_splits_of_a_plain_file(read, tmp_path, step):
    """Quality lines begin with @, and cuts fall on every kind of line."""
    names = [f"n{k}" for k in range(40)]
    (tmp_path / "reads.fastq").write_bytes(text(names) + b"@cut\nACGT\n")
    rows = read(r1=tmp_path / "reads.fastq", splitBytes=step).collect()
    assert [r.name for r in sorted(rows, key=lambda r: (r.start, r.record_no))] == names
    assert {r.seq_r2 for r in rows} == {None}


def test_mates_that_do_not_fit(read, tmp_path):
    one, two = tmp_path / "s_R1.fq", tmp_path / "s_R2.fq"
    one.write_bytes(text(["a", "b"]))
    for second in (["a", "c"], ["a"], ["a", "b", "c"]):
        two.write_bytes(text(second))
        with pytest.raises(Exception, match="BrokenPair"):
            read(r1=one, r2=two).collect()
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "t_R1.fq").write_bytes(text(["a"]))
    with pytest.raises(Exception, match="without mates"):
        read(r1=tmp_path / "only", r2=two).collect()
    one.write_bytes(b"@a\nACGT\n+\nFF\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        read(r1=one).collect()


def test_stream_reads_each_pair_once(spark, tmp_path):
    Q.register(spark)
    one, two = tmp_path / "1", tmp_path / "2"
    one.mkdir()
    two.mkdir()

    def run():
        stream = spark.readStream.format("fastq_pairs").option("r1", str(one)).option("r2", str(two)).load()
        q = stream.select("name", "seq_r2").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (one / "a_R1.fq").write_bytes(text(["a1", "a2"]))
    (two / "a_R2.fq").write_bytes(text(["a1", "a2"]))
    (one / "b_R1.fq").write_bytes(text(["b1"]))  # its mate has not come
    assert run() == ["a1", "a2"]
    (two / "b_R2.fq").write_bytes(text(["b1"]))
    assert run() == ["a1", "a2", "b1"]
    assert run() == ["a1", "a2", "b1"]


def test_matrix_and_numbered_files(spark, tmp_path):
    coo = spark.createDataFrame([(1, 2, 5.0), (3, 1, 2.0), (3, 2, 0.0)], "i long, j long, value double").repartition(2)
    sinks.write_matrix(coo, str(tmp_path / "m"))
    sinks.write_numbered(spark.createDataFrame([(3, "g4"), (1, "g2"), (2, "g3")], "line long, value string"), str(tmp_path / "f"))
    sinks.write_numbered(spark.createDataFrame([(0, "c1"), (1, "c2")], "line long, value string"), str(tmp_path / "b"))
    assert {(r.line, r.value) for r in T.lines(spark, str(tmp_path / "f")).collect()} == {(0, ""), (1, "g2"), (2, "g3"), (3, "g4")}
    got = T.parse_matrix(*(T.lines(spark, str(tmp_path / x)) for x in "mbf")).collect()
    assert {tuple(r) for r in got} == {("c2", "", 5.0), ("c1", "g3", 2.0)}


def test_heads_are_counted_over_runs_of_lines(spark, monkeypatch):
    """Contigs and features that cross runs of lines, in several files."""
    monkeypatch.setattr(T, "RUN_LINES", 4)
    rows, want = [], {}
    for file in "ab":
        line = 0
        for k in range(9):
            seq = ["ACGT"[(k + j) % 4] * (j + 1) for j in range(k % 6)]
            want[f"{file}{k}"] = "".join(seq)
            for value in [f">{file}{k} x", *seq]:
                rows.append((file, line, value))
                line += 1
    got = T.parse_fasta(spark.createDataFrame(rows, "file string, line long, value string").repartition(5))
    assert {r.name: r.seq for r in got.collect()} == want
    table = [("f", 0, "FEATURES")]
    for k in range(7):
        table += [("f", 3 * k + 1, f"     CDS             {k + 1}..{k + 9}"), ("f", 3 * k + 2, f'                     /gene="g{k}"'), ("f", 3 * k + 3, '                     /note="n"')]
    found = T.parse_genbank_features(spark.createDataFrame(table, "file string, line long, value string"))
    assert {tuple(r) for r in found.collect()} == {("CDS", k, k + 9, f"g{k}") for k in range(7)}
