"""What a round of the components costs the driver."""

from tidemark.llm.components import connected_components


def test_rounds_take_few_jobs(spark):
    context = spark.sparkContext
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 40)], "a long, b long")
    context.setJobGroup("rounds", "")
    found = connected_components(links, "a", "b")
    jobs = len(context.statusTracker().getJobIdsForGroup("rounds"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 140)}
    assert jobs <= 90
