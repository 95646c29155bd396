"""What stays in Python workers."""

from sieveline.llm import packing


def test_answers_are_packed_by_one_python_step(spark):
    turns = [(1, 0, "user", "a prompt, ΣΑΣ"), (1, 1, "assistant", "an answer <|endoftext|> x"), (2, 1, "assistant", None)]
    packed = packing.pack_answers(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    # Each step in Arrow batches has workers and tables of its own.
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id for r in packed.collect()} == {"1:1", "2:1"}
