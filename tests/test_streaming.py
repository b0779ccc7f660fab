from lacuna.streaming import match


def test_stream_equals_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("TTACGAAAACGTT\nGGGG\nAACGTTTTCGTAA\n")
    run = lambda: match.run_available(match.flanked_cores(match.read_lines(spark, str(tmp_path / "in")), "ACG", "CGT", 4), str(tmp_path / "out"), str(tmp_path / "check"))
    run()
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in match.flanked_cores(spark.read.text(str(tmp_path / "in")), "ACG", "CGT", 4).collect())
    assert got == want and len(got) >= 1
