"""Literal edge cases of the text formats."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from svmflow.functions.parsing import accepted, rejected
from svmflow.operators.log_rollup import log_rollup
from svmflow.plans import ingest_queries
from svmflow.sources.access_log import parse_log, sample_lines
from svmflow.sources.points import parse_points
from svmflow.sources.ratings import parse_ratings
from svmflow.sources.samples import parse_samples
from svmflow.sources.text import Landing, land_directory, read_lines, read_whole_files

GOOD_LOG = '10.0.0.1 - {user} [18/Jan/2013:17:56:07 +1100] "GET /a b HTTP/1.1" 200 {size} "http://r/" "agent" x'


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def by_value(df):
    return {r["value"]: r for r in df.collect()}


def test_samples(spark):
    texts = ["", "  ", "+1", "+1 1:2 3", "-1\t2:1e-3 7:4", "0 1:1", "+1 a:b", "x 1:1", "+1 1:2\t\f3:4:5:6", "1 1.5:2"]
    rows = by_value(parse_samples(lines(spark, *texts)))
    pairs = {t: [(f["idx"], f["val"]) for f in rows[t]["features"]] for t in texts}
    assert rows[""]["reject_reason"] == rows["  "]["reject_reason"] == "blank line"
    assert rows["+1"]["label"] == 1.0 and pairs["+1"] == [] and rows["+1"]["reject_reason"] is None
    assert rows["+1"]["label_text"] is None, "a line without a space has no label text"
    assert pairs["+1 1:2 3"] == [(1, 2.0)], "an odd last token is dropped"
    assert pairs["-1\t2:1e-3 7:4"] == [(2, 0.001), (7, 4.0)]
    assert rows["0 1:1"]["label"] == 0.0 and rows["0 1:1"]["label_text"] == "0"
    assert rows["+1 a:b"]["reject_reason"] == rows["1 1.5:2"]["reject_reason"] == "bad feature"
    assert rows["x 1:1"]["reject_reason"] == "bad label"
    assert pairs["+1 1:2\t\f3:4:5:6"] == [(1, 2.0), (3, 4.0), (5, 6.0)]


def test_good_and_bad_rows_part(spark):
    df = parse_samples(lines(spark, "+1 1:2", "+1 a:b"))
    assert [r["value"] for r in accepted(df).collect()] == ["+1 1:2"]
    assert [r["value"] for r in rejected(df).collect()] == ["+1 a:b"]


@pytest.mark.parametrize(
    ("parse", "good", "bad"),
    [(parse_samples, "+1 1:2", "+1 a:b"), (parse_points, "1 " * 11, "1 2"), (parse_ratings, "1::2::3::4", "1::2::3")],
)
def test_strict_mode_fails_the_job(spark, parse, good, bad):
    assert parse(lines(spark, good), mode="strict").count() == 1
    with pytest.raises(PySparkException, match="malformed row"):
        parse(lines(spark, good, bad), mode="strict").collect()
    with pytest.raises(ValueError):
        parse(lines(spark, good), mode="other")


def test_parse_runs_once_under_a_filter(spark):
    plan = accepted(parse_samples(read_lines(spark, "/root/repo/README.md")))._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("split(value") == 1


def test_points(spark):
    full = "1 " + " ".join(str(i / 4) for i in range(10))
    rows = by_value(parse_points(lines(spark, full, full + " 9 9", "1 2 3", full.replace("0.5", "z"), "", full.replace(" 0.5", "  0.5"))))
    assert rows[full]["x"] == [i / 4 for i in range(10)] and rows[full]["y"] == 1.0
    assert rows[full + " 9 9"]["x"] == rows[full]["x"], "extra fields are ignored"
    assert rows["1 2 3"]["reject_reason"] == rows[""]["reject_reason"] == "too few fields"
    assert rows[full.replace("0.5", "z")]["reject_reason"] == "bad number"
    assert rows[full.replace(" 0.5", "  0.5")]["reject_reason"] == "bad number"


def test_ratings(spark):
    texts = ["1::2::3.5::4", "1::2::3", "1::2::3::", "1::2::3::4::", "1::2::3::4::5", "1::x::3::4", "", "1::2::3::4:::", "3000000000::2::3::4"]
    rows = by_value(parse_ratings(lines(spark, *texts)))
    good = rows["1::2::3.5::4"]
    assert (good["user_id"], good["movie_id"], good["rating"], good["ts"]) == (1, 2, 3.5, 4)
    assert rows["1::2::3::4::"]["reject_reason"] is None, "empty fields at the end do not count"
    for bad in ("1::2::3", "1::2::3::", "1::2::3::4::5", "", "1::2::3::4:::"):
        assert rows[bad]["reject_reason"] == "not 4 fields", bad
    assert rows["1::x::3::4"]["reject_reason"] == rows["3000000000::2::3::4"]["reject_reason"] == "bad number"


def test_built_in_log(spark):
    (row,) = log_rollup(sample_lines(spark)).collect()
    assert (row["ip"], row["user"], row["query"]) == (
        "10.10.10.10", '"FRED"', "GET http://images.com/2013/Generic.jpg HTTP/1.1",
    )
    assert (row["n"], row["bytes"], row["bad_bytes"]) == (2, 621, 0)


def test_log_edges(spark):
    texts = [
        GOOD_LOG.format(user="bob", size=7),
        GOOD_LOG.format(user="-", size=8),
        GOOD_LOG.format(user="bob", size="-"),
        GOOD_LOG.format(user="bo\x01b", size=9),
        "no log line",
        "\x0110.0.0.1 7 bob GET",
        "",
    ]
    rows = by_value(parse_log(lines(spark, *texts)))
    assert [rows[t]["matched"] for t in texts] == [True, True, True, True, False, False, False]
    assert rows[texts[0]]["query"] == "GET /a b HTTP/1.1" and rows[texts[0]]["bytes"] == 7
    assert rows[texts[1]]["ip"] is None and rows[texts[1]]["bytes"] == 8
    assert rows[texts[2]]["bytes"] is None and rows[texts[2]]["user"] == "bob"
    assert rows[texts[3]]["user"] == "bo\x01b" and rows[texts[3]]["query"] == "GET /a b HTTP/1.1"
    totals = {(r["ip"], r["user"]): r for r in log_rollup(lines(spark, *texts)).collect()}
    assert (totals[None, None]["n"], totals[None, None]["bytes"]) == (4, 8)
    assert (totals["10.0.0.1", "bob"]["bytes"], totals["10.0.0.1", "bob"]["bad_bytes"]) == (7, 1)


def test_bytes_do_not_wrap(spark):
    big = 2_000_000_000
    (row,) = log_rollup(lines(spark, *[GOOD_LOG.format(user="u", size=big)] * 3)).collect()
    assert row["bytes"] == 3 * big


def test_the_pattern_runs_once_per_line(spark):
    plan = log_rollup(read_lines(spark, "/root/repo/README.md"))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("regexp_replace") == 1


def test_text_sources(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("x\ny\n")
    (tmp_path / "in" / "deep" / "b.txt").write_text("z\n")
    source, landed = str(tmp_path / "in"), str(tmp_path / "landed")
    assert {r["value"] for r in read_lines(spark, source).collect()} == {"x", "y", "z"}
    assert {r["value"] for r in read_whole_files(spark, source).collect()} == {"x\ny\n", "z\n"}
    table = land_directory(spark, source, landed)
    files = {r["value"]: r["source_file"].rsplit("/", 1)[1] for r in table.collect()}
    assert files == {"x": "a.txt", "y": "a.txt", "z": "b.txt"}
    assert land_directory(spark, source, landed).groupBy("value").count().agg(F.max("count")).first()[0] == 1
    with pytest.raises(PySparkException):
        land_directory(spark, str(tmp_path / "missing"), landed)


def test_landings_mirror_their_folder(spark, tmp_path):
    folder, other = tmp_path / "in", tmp_path / "other"
    (folder / "deep [x]").mkdir(parents=True)
    other.mkdir()
    names = ["a.txt", "b c%20*.txt", "deep [x]/d{1}.txt", "gone.txt", "empty.txt", "shrinks.txt"]
    for name in names:
        (folder / name).write_text("" if name == "empty.txt" else f"{name}\nsame\n")
    (other / "o.txt").write_text("o\n")
    landing = Landing(spark, str(tmp_path / "table"))
    assert landing.manifest().isEmpty()

    def status():
        return {r["path"].split("/in/")[-1].split("/other/")[-1]: r["status"] for r in landing.manifest().collect()}

    landing.land(str(folder))
    assert status() == dict.fromkeys(names, "new")
    assert landing.lines().count() == 10
    landing.land(str(other))
    assert landing.lines().count() == 11, "another folder adds to the table"
    before = {r["value"]: r["source_file"] for r in landing.lines().collect()}
    (folder / "gone.txt").unlink()
    (folder / "shrinks.txt").write_text("")
    (folder / "a.txt").write_text("a.txt\nnow other\nlines\n")
    (folder / "e.txt").write_text("e\n")
    landing.land(str(folder))
    assert status() == {
        "a.txt": "changed", "b c%20*.txt": "unchanged", "deep [x]/d{1}.txt": "unchanged", "gone.txt": "removed",
        "empty.txt": "unchanged", "shrinks.txt": "emptied", "e.txt": "new", "o.txt": "unchanged",
    }
    wanted = ["a.txt", "now other", "lines", "b c%20*.txt", "same", "deep [x]/d{1}.txt", "same", "e", "o"]
    assert sorted(r["value"] for r in landing.lines().collect()) == sorted(wanted)
    assert {r["value"]: r["source_file"] for r in landing.lines().collect()}["a.txt"] == before["a.txt"]
    # A landing that broke off behind its lines leaves the table as it was, and the next one takes its place.
    spark.createDataFrame([("stray", before["a.txt"])], "value string, source_file string").write.parquet(
        str(tmp_path / "table" / "lines" / "landing=4")
    )
    assert sorted(r["value"] for r in landing.lines().collect()) == sorted(wanted)
    (folder / "gone.txt").write_text("back\n")
    Landing(spark, str(tmp_path / "table")).land(str(folder))
    assert sorted(r["value"] for r in landing.lines().collect()) == sorted([*wanted, "back"])
    assert status()["gone.txt"] == "new" and "removed" not in status().values()


def test_every_task_writes_the_files_of_a_landed_folder(spark, tmp_path, monkeypatch):
    """The files are not brought together in one task, and a part without rows has none."""
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey % 5 <> 0")
    rows.repartition(4).write.parquet(f"{tmp_path}/sf/lineitem.parquet")
    monkeypatch.setattr(ingest_queries, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    found = {r["part"]: r for r in ingest_queries.dir_manifest(spark, f"{tmp_path}/sf").collect()}
    n = {part: rows.where(f"l_orderkey % 5 = {part}").count() for part in range(5)}
    assert {part: (r["status"], r["n_lines"]) for part, r in found.items()} == {
        1: ("changed", n[1]), 2: ("emptied", 0), 3: ("removed", 0), 4: ("new", n[4])
    }
    assert len(list(tmp_path.glob("rating-files/**/part=1/part-*.txt"))) == 4


def test_lines_of_a_landing_are_not_dealt_by_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\n2\n")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        landed = land_directory(spark, str(tmp_path / "in"), str(tmp_path / "table"))
        assert sorted(r["value"] for r in landed.collect()) == ["1", "2"]
        assert "SortMergeJoin" not in landed._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
