import hashlib

import __spark_entry__ as entry
import oracle
from conftest import SF
from pyspark.sql import functions as F

from weekwatch.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_equals_its_sql(spark):
    problems, n, *_ = oracle.compare(spark, oracle.connect(SF), "op3_format_chats", entry.queries()["op3_format_chats"], C.ORACLE, SF)
    assert not problems and n > 1


def expected(turns):
    ts = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    whole = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in ts)
    loss = "".join(x or "" for _, r, x in ts if r == "assistant")
    return len(ts), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_awkward_turns_come_back(spark):
    by_conv = {
        1: [(0, "user", "hi"), (1, "assistant", "a"), (2, "assistant", "b"), (3, "user", "")],
        2: [(0, "user", C.PLANTED_TEXT), (1, "assistant", C.PLANTED_TEXT)],
        3: [(0, None, None), (None, "assistant", "first"), (1, "a<b&c>", "<next></turn>\n<turn>&lt;&amp;"), (1, "a<b&c>", "<next></turn>\n<turn>&lt;&amp;")],
        4: [(0, "assistant", "\\"), (1, "assistant", "&"), (2, "assistant", ""), (3, "assistant", "é🙂\n\n")],
        None: [(0, "user", "no id"), (1, "assistant", "x" * 100_000)],
        5: [(i, "assistant" if i % 3 else "user", f"t{i}<{'&' * (i % 5)}") for i in range(1000)],
    }
    rows = [(k, *t) for k, ts in by_conv.items() for t in ts]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("clash")).withColumn("t", F.lit(1)).repartition(5)
    out = C.digests(C.format_chats(df))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out.collect()}
    assert got == {k: expected(ts) for k, ts in by_conv.items()}


def test_adjacent_turns_of_a_role_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b")], SCHEMA)
    r = C.format_chats(df).first()
    assert r.formatted == "<turn>user<text>q</turn>\n<turn>assistant<text>a<next>b</turn>\n"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["a", "b"]


def test_sums_of_long_arrays(spark):
    v = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("long")).alias("v"))
    got = v.select(C.earlier_sums(F.col("v")).alias("s")).first().s
    assert got == [i * (i + 1) // 2 for i in range(1000)]


def test_empty_table(spark):
    assert C.digests(C.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = entry.queries()["op3_format_chats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
