import random

from weekwatch.llm.graph import components


def plain(links):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = (find(parent.setdefault(x, x)) for x in (a, b))
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_random_links(spark):
    rnd = random.Random(3)
    links = [(rnd.randint(-(1 << 63), (1 << 63) - 1), -5) for _ in range(20)] + [(x, x) for x in range(9000, 9010)]
    for n, m in ((40, 30), (300, 160), (300, 900)):
        at = rnd.randint(-5000, 5000) * 1000
        links += [(at + rnd.randrange(n), at + rnd.randrange(n)) for _ in range(m)]
    links += links[::3] + [(b, a) for a, b in links[::5]]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    out = components(df).collect()
    assert len(out) == len({r.node for r in out})
    assert {r.node: r.root for r in out} == plain(links)


def tasks_of(spark, run):
    sc = spark.sparkContext
    sc.setJobGroup("components", "")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    status = sc.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("components") for s in status.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)


def test_few_links_take_few_tasks(spark):
    """Every task leaves files and log entries; a few links used to take 11 tasks for each shuffle partition and round."""
    links = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(300)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(links, "a long, b long")
        n = tasks_of(spark, lambda: components(df).count())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    print("tasks", n)
    assert 0 < n <= 40 * 40
