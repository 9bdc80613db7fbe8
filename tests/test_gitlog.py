"""Landed git logs as a stream: every commit once, by sha."""

from datetime import datetime

from kbspark.sources.gitlog import GitLogSource, commits


def dump(path, shas):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\x1e\n".join(f"{s}\x00ann\x00{d}\x00subject {s}\x00body" for s, d in shas) + "\x1e\n")


def test_commits_arrive_once_by_sha(spark, tmp_path):
    spark.dataSource.register(GitLogSource)
    day = "2024-01-{:02d}T00:00:00"
    log = lambda *shas: [(s, day.format(int(s[1:]) if s[1:].isdigit() else 5)) for s in shas]

    def poll():
        stream = spark.readStream.format("gitlog").option("first", 3).load(str(tmp_path / "logs"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(f"{r.repository}-{r.sha}" for r in spark.read.parquet(str(tmp_path / "out")).collect())

    dump(tmp_path / "logs/r/1.log", log("s5", "s4", "s3", "s2", "s1"))
    assert poll() == ["r-s3", "r-s4", "r-s5"] and poll() == ["r-s3", "r-s4", "r-s5"]
    # A rebase: s5 is gone, others have its second or are older; a repeated record; another repository.
    dump(tmp_path / "logs/r/2.log", [*log("s9", "same"), ("old", "2019-01-01T00:00:00"), ("bad", "no date"), *log("s9", "s4", "s3", "s2", "s1")])
    dump(tmp_path / "logs/q/1.log", log("s4"))
    assert poll() == ["q-s4", "r-bad", "r-old", "r-s3", "r-s4", "r-s5", "r-s9", "r-same"]
    assert poll() == ["q-s4", "r-bad", "r-old", "r-s3", "r-s4", "r-s5", "r-s9", "r-same"]


def test_records():
    found = list(commits("a\x00x\x002024-01-01T00:00:00Z\x00s\x00b\nc\x1e\nbroken\x00x\x1e\n\x1e"))
    assert [(c[0], c[3], c[4]) for c in found] == [("a", "s", "b\nc")] and found[0][2].replace(tzinfo=None) == datetime(2024, 1, 1)
