import collections
import hashlib
import itertools
import math
import re

import numpy as np
from conftest import SF
from helpers import documents, empty

import __spark_entry__ as entry
from weekwatch.llm import quality as Q

SPACES = "[\\x20\\x09-\\x0D]"


def statistics(text):
    t = text or ""
    w = re.findall("[^\\x20\\x09-\\x0D]+", t)
    windows, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    # n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines)


def vector(s):
    n = max(s[0], 1)
    return [math.log(max(s[1] / n, 1)), math.sqrt(s[2] / n), math.sqrt(s[4] / n), math.sqrt(s[3] / max(s[5], 1))]


def rank(x, q):
    return np.sort(x)[max(math.ceil(q * len(x)) - 1, 0)]


def log_det(v):
    return np.linalg.slogdet(v)[1]


def concentrated(x, m, v):
    floor = np.array([Q.FLOORS[c] for c in Q.VECTOR])
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v), x - m)
    near = x[d <= rank(d, Q.SHARE) * (1 + 1e-12)]
    return near.mean(0), np.atleast_2d(np.cov(near.T, bias=True)) * Q.CONSISTENCY + np.diag(floor**2)


def estimate(x, lots):
    """Mean and inverse covariance of the least determinant, by the same starts and steps with whole matrices."""
    floor = np.array([Q.FLOORS[c] for c in Q.VECTOR])
    m = np.array([rank(c, 0.5) for c in x.T])
    found = [(m, np.diag(np.maximum(1.4826 * np.array([rank(np.abs(c - a), 0.5) for c, a in zip(x.T, m)]), floor) ** 2))]
    for s in range(1, Q.STARTS):
        part = x[[int(lot[8 * s - 8 : 8 * s], 16) % max(1, len(x) // Q.SUBSET) == 0 for lot in lots]]
        if len(part):
            found.append((part.mean(0), np.atleast_2d(np.cov(part.T, bias=True)) + np.diag(floor**2)))
    for _ in range(Q.FIRST_STEPS):
        found = [concentrated(x, *f) for f in found]
    m, v = min(found, key=lambda f: log_det(f[1]))
    while True:
        m2, v2 = concentrated(x, m, v)
        if log_det(v2) >= log_det(v) - Q.SETTLED:
            return m, np.linalg.inv(v)
        m, v = m2, v2


def verdicts(rows, least=Q.LEAST):
    """kept of each (lang, source, text)."""
    stats = [statistics(t) for _, _, t in rows]
    failed = [s[0] < 50 or 100 * s[4] > 50 * s[0] for s in stats]
    groups = collections.defaultdict(list)
    for (lang, source, _), s, f in zip(rows, stats, failed):
        if not f:
            for key in ((0, lang, source), (1, lang, None), (2, None, None)):
                groups[key].append((vector(s), hashlib.md5(",".join(map(str, s)).encode()).hexdigest()))
    fits = {k: estimate(np.array([x for x, _ in v]), [lot for _, lot in v]) for k, v in groups.items() if len(v) >= least}
    out = []
    for (lang, source, _), s, f in zip(rows, stats, failed):
        fit = next((fits[k] for k in ((0, lang, source), (1, lang, None), (2, None, None)) if k in fits), None)
        d = 0.0 if fit is None else float((np.array(vector(s)) - fit[0]) @ fit[1] @ (np.array(vector(s)) - fit[0]))
        out.append((*s[:5], f, not f and d <= Q.CUTOFF, d))
    return out


def check(df, **k):
    rows = df.collect()
    want = verdicts([(r.lang, r.source, r.text) for r in rows], **k)
    got = Q.judged(df, **k).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(rows, want)), key=str)
    got = sorted(map(tuple, got), key=str)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    # distances that lie on the cutoff to the last digits may fall either way
    assert all(g[7] == w[7] for g, w in zip(got, want) if abs(w[8] - Q.CUTOFF) > 1e-6)


def test_documents_against_whole_matrices(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), least=5)


def test_good_texts_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = Q.judged(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in seen}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) == 0


def test_awkward_rows(spark):
    docs = documents(spark, extra=("n_words", "kept", "level", "x_length"))
    check(docs)
    kept = Q.kept_documents(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [5]
    assert Q.judged(empty(spark)).count() == 0 and Q.kept_documents(empty(spark)).count() == 0


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a a a a", "a b c d a b c x b c d", "x y z", "a b", "one two three\none two three\nx\nx\n \n", "r " * 5000]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], documents(spark).schema)
    check(df)


def test_least_determinant_of_all_subsets(spark):
    rng, rows, want = np.random.default_rng(8), [], {}
    for g in range(4):
        x = rng.normal(size=(14, 4)) * [0.2, 0.3, 0.2, 0.3]
        x[:3] += rng.normal(size=(3, 4)) + 3
        rows += [(str(g), "s", *map(float, v), hashlib.md5(str(v).encode()).hexdigest()) for v in x]
        floor, h = np.array([Q.FLOORS[c] for c in Q.VECTOR]), math.ceil(Q.SHARE * 14)
        want[str(g)] = min(log_det(np.cov(x[list(c)].T, bias=True) * Q.CONSISTENCY + np.diag(floor**2)) for c in itertools.combinations(range(14), h))
    df = spark.createDataFrame(rows, ["lang", "source", *Q.VECTOR, "lot"])
    got = {r.g_lang: r.det for r in Q.fit(df).where("level = 0").collect()}
    assert all(want[g] - 1e-9 <= got[g] <= want[g] + 0.3 for g in want) and sum(abs(got[g] - want[g]) < 1e-6 for g in want) >= 2


def test_quantiles():
    assert abs(Q.chi2_quantile(0.95, 4) - 9.4877) < 1e-3 and abs(Q.chi2_below(9.4877, 4) - 0.95) < 1e-4


def test_no_python_in_the_plan(spark):
    plan = entry.queries()["op7_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_one_extreme_statistic_rejects(spark):
    fresh = iter(range(10**7))
    w = lambda n: [f"w{next(fresh):06d}" for _ in range(n)]
    clean = ["\n".join(" ".join(w(10)) for _ in range(12)) for _ in range(80)]
    block = w(24)
    lines = "\n".join(["w999999"] * 40 + [" ".join(w(100)) for _ in range(3)])  # 91 % of the lines, 12 % of the words
    repeats = " ".join([*block, *w(50), *block])  # 49 % of the words, on one line
    symbols = " ".join([x + "##" for x in w(60)])  # two a word
    length = " ".join(x * 12 for x in w(100))
    odd = [lines, repeats, symbols, length]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*clean, *odd])], documents(spark).schema)
    rows = {r.doc_id: r for r in Q.judged(df).collect()}
    assert not any(rows[80 + i].base_failed for i in range(4))
    assert all(rows[i].kept for i in range(80)) and not any(rows[80 + i].kept for i in range(4))


def test_steps_are_few_jobs(spark):
    rng = np.random.default_rng(4)
    rows = [(str(g), "s", *map(float, rng.normal(size=4)), hashlib.md5(f"{g},{i}".encode()).hexdigest()) for g in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, ["lang", "source", *Q.VECTOR, "lot"]).cache()
    calls, seen = [], Q._concentrated

    def counted(*args):
        calls.append(1)
        return seen(*args)

    spark.sparkContext.setJobGroup("fit", "fit")
    Q._concentrated = counted
    try:
        assert Q.fit(df).count() == 7
    finally:
        Q._concentrated = seen
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    assert jobs < 14 * len(calls)  # 46 jobs in three steps by checkpoints, 36 by tables
