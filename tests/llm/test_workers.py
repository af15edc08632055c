"""What a Python worker keeps from task to task."""

from verdigraph.llm import common


class Made:
    def __init__(self, *args):
        self.args = args


def test_one_kind_of_work_is_held_at_a_time():
    first = common.hold(Made, "a", 1)
    assert common.hold(Made, "a", 1) is first and first.args == ("a", 1)
    second = common.hold(Made, "b")
    assert second is not first and common.hold(Made, "a", 1) is not first
    common.let_go()
    assert not common._HELD
    common.let_go()


def test_other_work_lets_go(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string").coalesce(1)

    def holding(ids, rows):
        return {"doc_id": ids, "n": [int(common.hold(complex, 1).real)] * len(ids)}

    def counting(ids, rows):
        return {"doc_id": ids, "n": [len(common._HELD)] * len(ids)}

    assert {r["n"] for r in common.map_texts(docs, holding, "doc_id long, n long", holds=True).collect()} == {1}
    assert {r["n"] for r in common.map_texts(docs, counting, "doc_id long, n long").collect()} == {0}
    common.map_texts(docs, holding, "doc_id long, n long", holds=True).collect()
    assert {r["n"] for r in common.map_texts(docs, counting, "doc_id long, n long", holds=True).collect()} <= {0, 1}
