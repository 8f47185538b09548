from helpers import SF
from pyspark.sql import functions as F

from svmflow.functions.parsing import accepted
from svmflow.operators.scoring import Scorer
from svmflow.plans import fixtures as fx
from svmflow.sources.model_store import save_model
from svmflow.sources.samples import parse_samples
from svmflow.sources.text import read_lines
from svmflow.streaming.ingest import file_accuracy, follow_arrivals, ingest_stream, score_arrivals, score_stream


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))


def test_scores_equal_batch_also_after_a_restart(spark, tmp_path):
    model = fx.binary_model(spark, SF, "fixed", kernel_type="linear")
    scorer = Scorer(*model)
    rows = fx.table(spark, SF, "embeddings").orderBy("vec_id")
    sign = F.when(F.col("label") < 5, "+1").otherwise("-1")
    lines = [r["v"] for r in rows.select(fx.dense_line(sign).alias("v")).collect()]
    source, table, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        query = score_stream(spark, str(source), scorer, table, state, run_ts="r1", max_files=1)
        query.awaitTermination()
        return query, spark.read.parquet(table)

    write(source, "a.txt", lines[:200] + ["", "x 1:1"])
    write(source, "b.txt", lines[200:300])
    _, out = run()
    assert out.count() == 302
    bad = out.where("reject_reason is not null").collect()
    assert len(bad) == 2 and all(r["prediction"] is None and r["decision"] is None for r in bad)
    write(source, "c.txt", lines[300:])
    query, out = run()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 200, "only the new file is read"
    samples = accepted(parse_samples(read_lines(spark, str(source)))).withColumnRenamed("label", "target")
    batch = scorer.score(samples).select("value", "target", "prediction", "decision")
    stream = out.where("reject_reason is null").select("value", "target", "prediction", "decision")
    assert stream.exceptAll(batch).isEmpty() and batch.exceptAll(stream).isEmpty()

    per_file = {r["source_file"].rsplit("/", 1)[1]: r for r in file_accuracy(out).collect()}
    assert {k: r["total"] for k, r in per_file.items()} == {"a.txt": 200, "b.txt": 100, "c.txt": 200}
    hits = out.where("prediction = target").count()
    assert sum(r["correct"] for r in per_file.values()) == hits


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, table, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    write(source, "a.txt", ["1", "2"])
    ingest_stream(spark, str(source), table, state).awaitTermination()
    write(source, "b.txt", ["3"])
    ingest_stream(spark, str(source), table, state).awaitTermination()
    found = sorted((r["value"], r["source_file"].rsplit("/", 1)[1]) for r in spark.read.parquet(table).collect())
    assert found == [("1", "a.txt"), ("2", "a.txt"), ("3", "b.txt")]


def test_a_running_stream_can_be_stopped(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "a.txt", ["1"])
    query = ingest_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"), once=False)
    try:
        query.processAllAvailable()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    finally:
        query.stop()


def test_arrivals_meet_the_newest_run(spark, tmp_path):
    source, store, table, state = (str(tmp_path / n) for n in ("in", "store", "out", "state"))

    def save(run_ts, rho):
        save_model(*fx.binary_model(spark, SF, "m", kernel_type="linear", rho=[rho]), store, run_ts=run_ts)

    def runs():
        found = spark.read.parquet(table).select("source_file", "run_ts", "prediction").collect()
        return sorted((r["source_file"].rsplit("/", 1)[1], r["run_ts"], r["prediction"]) for r in found)

    write(tmp_path / "in", "a.txt", ["+1 1:0.5", "-1 2:1"])
    save("20240101000000", -1e6)
    assert score_arrivals(spark, source, store, "m", table, state) == "20240101000000"
    first = [("a.txt", "20240101000000", 1.0)] * 2
    assert runs() == first
    save("20240102000000", 1e6)
    assert score_arrivals(spark, source, store, "m", table, state) == "20240102000000"
    assert runs() == first, "what has been scored stays"
    write(tmp_path / "in", "b.txt", ["+1 1:0.5"])
    save("20230101000000", -1e6)
    score_arrivals(spark, source, store, "m", table, state)
    second = [*first, ("b.txt", "20240102000000", -1.0)]
    assert runs() == second

    turns = iter([False, False, True])

    def stopped():
        """Between two micro-batches of a running stream: a newer run, then another file."""
        stop = next(turns)
        if not stop:
            save("20240103000000", -1e6)
            write(tmp_path / "in", "c.txt", ["-1 1:0.5"])
        return stop

    follow_arrivals(spark, source, store, "m", table, state, stopped=stopped, every=0.0)
    assert runs() == [*second, ("c.txt", "20240103000000", 1.0)]
