import random

from tidemark.llm import resolve as R
from tidemark.operators.components import components


def test_one_task_and_steps_give_the_same_components(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(-5, 9_000_000_000_000), (7777, 7777), (None, 3)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    one, steps = ({tuple(x) for x in components(edges, whole=w).collect()} for w in (1 << 20, 0))
    assert one == steps and (300, 0) in one and (9_000_000_000_000, -5) in one and not any(x == 7777 for x, _ in one)
    assert components(edges.filter("a = 7777"), whole=1 << 20).collect() == []


def test_few_jobs_and_no_broadcast_of_keys(spark):
    """The driver's memory follows the number of steps: 65 jobs over sf0.1, 132 when every match was a step of its own."""
    c = spark.createDataFrame([("c1", "Tomesoxan Immunology", ["TMXI"]), ("c2", "Tomesoxan Immunology Ltd.", None)], "id string, display_name string, aliases array<string>")
    r = spark.createDataFrame(
        [("r1", "Tomesxan Immunol. Ltd"), ("r2", "TMXI"), ("r3", "Tomesoxan"), ("r4", "Bill Cebrafisyn Lab"), ("r5", "W. Cebrafisin Lab"), ("r6", "Keroluqubar"), ("r7", "Keroluqbar")],
        "id string, organization string",
    )
    spark.sparkContext.setJobGroup("resolve", "resolve")
    got = {tuple(x) for x in R.found_pairs(R.resolve(c, r)).distinct().collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("resolve"))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert got == {("c1", "c2"), ("c1", "r1"), ("c2", "r1"), ("c1", "r2"), ("c2", "r2"), ("c1", "r3"), ("c2", "r3"), ("r4", "r5"), ("r6", "r7")}
    assert jobs <= 75
    left = spark.createDataFrame([(1, "tomesoxan")], "a bigint, stem string")
    right = spark.createDataFrame([(2, "tomesoxam"), (3, "tomesoxan"), (4, "keroluqubar")], "b bigint, ps string")
    pairs = R._pairs(left, right, [], "a", "b")
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.a, x.b) for x in pairs.collect()) == [(1, 2), (1, 3)]
