import pytest
from pyspark.sql import functions as F

from verdigraph import scratch_path, shared_dir
from verdigraph import sources as IO
from verdigraph.operators import losses as L
from verdigraph.operators.baseline import fit_baseline, score_baseline
from verdigraph.streaming import drain_to_table, score_stream

LOG = "config string, idx string, target int, response string"


class Session:
    """Just enough of a session to ask where shared files go."""

    def __init__(self, master, configured=None):
        self.sparkContext, self.master, self.dir = self, master, None
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


def test_shared_dir_is_the_clusters():
    session = Session("yarn", "hdfs:///shared/run")
    assert shared_dir(session) == "hdfs:///shared/run" == session.dir
    assert scratch_path(session, "x").startswith("hdfs:///shared/run/x-")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("yarn"))
    assert shared_dir(Session("local[2]"))


def test_malformed_corpus_line_raises(spark):
    path = scratch_path(spark, "bad")
    spark.createDataFrame([('{"idx": "1", "func": "x", "target": 1}',), ("{broken",)], "value string").write.text(path)
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        IO.read_corpus(spark, path).collect()


def test_corpus_takes_numbers_as_idx(spark):
    path = scratch_path(spark, "numbers")
    spark.createDataFrame([('{"idx": 7, "func": "x", "target": 1, "extra": [1]}',)], "value string").write.text(path)
    assert tuple(IO.read_corpus(spark, path).first()) == ("7", "x", 1)


def test_corpus_rows_must_be_whole(spark):
    path = scratch_path(spark, "lacking")
    spark.createDataFrame([('{"idx": 7, "func": "x"}',)], "value string").write.text(path)
    with pytest.raises(Exception, match="no target"):
        IO.read_corpus(spark, path).collect()


def test_missing_log_is_empty(spark):
    assert IO.read_responses(spark, scratch_path(spark, "none")).count() == 0


def test_prediction_lines(spark):
    path = scratch_path(spark, "lines")
    IO.write_predictions(spark.createDataFrame([("a%d", 1, 0)], "idx string, pred int, target int"), path)
    assert spark.read.text(path).first()[0] == "idx: a%d, pred: 1, target: 0"


def test_generations_split(spark):
    rows = spark.createDataFrame([(1, 1), (2, None)], "idx int, pred int")
    valid, invalid = IO.split_generations(rows)
    assert [r["idx"] for r in valid.collect()] == [1] and [r["idx"] for r in invalid.collect()] == [2]


def test_stream_equals_batch(spark):
    folder = scratch_path(spark, "stream")
    rows = [(str(i % 2), str(i), i % 2, ["yes", "no", "hm"][i % 3]) for i in range(200)]
    for part in (rows[:80], rows[80:], rows[50:120]):
        spark.createDataFrame(part, LOG).write.mode("append").json(folder)
    drained = drain_to_table(score_stream(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 5).json(folder)))
    batch = score_stream(spark.createDataFrame(rows, LOG))
    assert sorted(map(tuple, drained.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_with_event_time(spark):
    folder = scratch_path(spark, "timed")
    rows = [("a", str(i % 30), 1, "yes", i) for i in range(60)]
    schema = LOG + ", ts timestamp"
    spark.createDataFrame(rows, LOG + ", s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.json(folder)
    stream = spark.readStream.schema(schema).json(folder)
    assert drain_to_table(score_stream(stream, event_time="ts")).first()["n_total"] == 30


def test_short_last_batch_weighs_as_much(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 4.0)], "batch int, loss double")
    assert L.batch_mean_loss(rows).first()["loss"] == 2.5


def test_group_needs_every_position_once(spark):
    schema = "`group` int, pos int, view1 array<float>, view2 array<float>"
    good = [(0, 0, [1.0, 0.0], [1.0, 0.0]), (0, 1, [0.0, 1.0], [0.0, 2.0])]
    sims = L.group_cosine(L.to_groups(spark.createDataFrame(good, schema), 2)).orderBy("row").collect()
    assert [r["sims"] for r in sims] == [[1.0, 0.0], [0.0, 1.0]]
    for bad in ([good[0]], [good[0], good[0]], [good[0], (0, 2, [1.0, 0.0], [1.0, 0.0])]):
        with pytest.raises(Exception, match="each position"):
            L.group_cosine(L.to_groups(spark.createDataFrame(bad, schema), 2)).collect()


def test_check_eos(spark):
    rows = spark.createDataFrame([([2, 2],), ([2],)], "input_ids array<int>")
    assert L.check_eos(rows, 2).first()["uniform"] is False
    with pytest.raises(Exception, match="same number of EOS"):
        L.check_eos(rows, 2, strict=True).collect()


def test_pool_vectors(spark):
    links = spark.createDataFrame([(1, 0, 5), (1, 0, 6)], "idx int, node int, token int")
    vectors = spark.createDataFrame([(1, 5, [1.0, 2.0]), (1, 6, [3.0, 6.0])], "idx int, token int, vector array<float>")
    got = L.pool_vectors(links, vectors).first()
    assert got["n_tokens"] == 2 and [round(x, 6) for x in got["vector"]] == [2.0, 4.0]


def test_baseline_learns_a_word(spark):
    rows = spark.createDataFrame([(i, "free free ptr" if i % 2 else "return ok value", i % 2) for i in range(60)], "idx bigint, func string, target int")
    fitted = fit_baseline(rows, rows)
    assert fitted.valid_bacc == 1.0 and fitted.reg == 0.01
    assert score_baseline(fitted, rows).where("pred <> target").count() == 0
