import collections

from helpers import documents, empty

from weekwatch.llm import linededup as L


def expected(rows):
    """Texts by (doc_id, text) after every chunk but the first of equal bytes has gone."""
    from pyspark.sql import functions as F  # noqa: F401

    seen = collections.defaultdict(list)
    for doc, text, text_hash in {(r[0], r[1], r[2]) for r in rows if r[1] is not None}:
        lines = text.encode().split(b"\n")
        starts, words = L.chunk_bounds(lines)
        for no, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)])):
            n = sum(words[a:b])
            if n >= L.LONG_WORDS or (b - a >= L.LEAST_LINES and n >= L.LEAST_WORDS):
                seen[b"\n".join(lines[a:b])].append(((doc is not None, doc or 0, text_hash, no), (doc, text), a, b))
    gone = collections.defaultdict(set)
    for places in seen.values():
        for _, key, a, b in sorted(places, key=lambda p: p[0])[1:]:
            gone[key] |= set(range(a, b))
    return {k: "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in lines) for k, lines in gone.items()}


def check(docs):
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.text, r.h) for r in docs.withColumn("h", F.xxhash64("text")).select("doc_id", "text", "h").collect()]
    changed = expected(rows)
    want = sorted(((i, changed.get((i, t), t)) for i, t, _ in rows), key=str)
    got = L.remove_repeated(docs, carry=("lang",))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    assert got.where("lines_removed > 0").count() == sum((i, t) in changed for i, t, _ in rows)
    return len(changed)


def test_documents_against_brute_force(spark, sf):
    assert check(spark.read.parquet(f"{sf}/documents.parquet")) > 0


def test_awkward_rows_and_shared_passages(spark):
    line = " ".join(f"w{i}" for i in range(60))
    several = "\n".join(" ".join(f"v{i}x{j}" for j in range(14)) for i in range(12))
    rows = [(100 + i, f"start {i}\n{several}\nend of {i}\n{line}", "en", f"s{i % 2}", 0) for i in range(25)]
    rows += [(None, line, "en", "a", 0), (None, line, None, None, 0), (900, f"{line}\n{line}", "en", "a", 0), (901, "a short line\nanother", "en", "a", 0), (902, "a short line\nanother", "en", "a", 0)]
    docs = documents(spark).unionByName(spark.createDataFrame(rows, documents(spark).schema)).selectExpr("*", "'x' as spans", "1 as hash", "2 as removed")
    assert check(docs.repartition(7)) > 20
    out = {r.doc_id: r for r in L.remove_repeated(docs).where("doc_id > 99").collect()}
    assert out[900].text == "" and out[901].text == out[902].text == "a short line\nanother"
    assert line not in out[101].text and out[101].words_removed >= 60


def test_boundaries_come_back_after_an_insertion():
    lines = [f"line {i} {i * i}".encode() for i in range(400)]
    a, _ = L.chunk_bounds(lines)
    b, _ = L.chunk_bounds([*lines[:100], b"inserted", *lines[100:]])
    assert {x + 1 for x in a if x > 103} == {x for x in b if x > 104}
    assert L.chunk_bounds([b""])[0] == [0]


def test_empty_table(spark):
    assert L.remove_repeated(empty(spark)).count() == 0


def without_runs(rows, whole_texts=False):
    """Texts by (doc_id, text) after the chunk rule and without every run of over 50 words that an earlier place has: all pairs of equal lines.

    With `whole_texts`, a text of 1 to 50 words that an earlier place has goes as well."""
    texts = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    places, gone = collections.defaultdict(list), collections.defaultdict(set)
    lines = [t.split("\n") for _, t, _ in texts]
    for d, x in enumerate(lines):
        for i, line in enumerate(x):
            places[line].append((d, i))
    for at in places.values():
        for n, (d, i) in enumerate(at):
            for e, j in at[:n]:
                x, y = lines[d], lines[e]
                if d == e or (i and j and x[i - 1] == y[j - 1]):
                    continue
                k = 0
                while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k]:
                    k += 1
                if sum(len(w.encode().split()) for w in x[i : i + k]) > 50:
                    gone[d] |= set(range(i, i + k))
    for d, x in enumerate(lines):
        words = [len(w.encode().split()) for w in x]
        for i in range(len(x)):
            for j in range(i):
                k = 0
                while k < i - j and i + k < len(x) and x[i + k] == x[j + k]:
                    k += 1
                if sum(words[i : i + k]) > 50:
                    gone[d] |= set(range(i, i + k))
    seen = collections.defaultdict(list)
    for d, x in enumerate(lines):
        starts, words = L.chunk_bounds([w.encode() for w in x])
        for a, b in zip(starts, [*starts[1:], len(x)]):
            if sum(words[a:b]) >= L.LONG_WORDS or (b - a >= L.LEAST_LINES and sum(words[a:b]) >= L.LEAST_WORDS):
                seen["\n".join(x[a:b])].append((d, a, b))
    for at in seen.values():
        for d, a, b in at[1:]:
            gone[d] |= set(range(a, b))
    if whole_texts:
        first = {}
        for d, (_, text, _) in enumerate(texts):
            if first.setdefault(text, d) < d and 0 < len(text.encode().split()) <= L.RUN_WORDS:
                gone[d] |= set(range(len(lines[d])))
    return {(t[0], t[1]): "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d]) for d, t in enumerate(texts)}


def check_runs(docs):
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.text, r.h) for r in docs.withColumn("h", F.xxhash64("text")).select("doc_id", "text", "h").collect()]
    want = without_runs(rows)
    got = L.remove_repeated(docs, run_words=L.RUN_WORDS).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((i, want.get((i, t), t)) for i, t, _ in rows), key=str)
    return got


def test_no_repeated_run_is_left(spark, sf):
    check_runs(spark.read.parquet(f"{sf}/documents.parquet"))


def test_runs_that_chunks_do_not_hold(spark):
    import random

    rnd, at = random.Random(3), iter(range(10**6))
    line = lambda n: " ".join(f"u{next(at)}" for _ in range(n))
    shared = [[line(n) for n in ns] for ns in ((25, 25, 3), (41, 43), (20, 0, 31), (51,), (10,) * 6, (25, 25), (3, 48, 1))]
    rows = []
    for d in range(60):
        x = [line(rnd.randint(1, 40)) for _ in range(3)]
        for s in rnd.sample(shared, 2):
            x += [*s, line(rnd.randint(1, 60))]
        rows.append((d, "\n".join(x), "en", "a", 0))
    rows += [(900, "\n".join([*["again " * 20] * 9, line(5)]), "en", "a", 0), (None, "\n".join(shared[0]), "en", "a", 0)]
    out = {r.doc_id: r for r in check_runs(spark.createDataFrame(rows, documents(spark).schema).repartition(5))}
    kept = "\n".join(r.text for r in out.values())
    # each passage stays once; one of 50 words is not over 50
    assert all(kept.count("\n".join(s)) == 1 for s in shared if sum(len(x.split()) for x in s) > 50)
    assert out[900].text.count("again") == 60 and out[None].lines_removed == 0
    assert L.remove_repeated(empty(spark), run_words=L.RUN_WORDS).count() == 0


def test_windows_are_compared_by_bytes(spark):
    from pyspark.sql import functions as F

    passage = [" ".join(f"p{i}q{j}" for j in range(18)) for i in range(5)]
    rows = [(d, "\n".join([f"own {d}", *passage[d % 2 :], f"end {d}"])) for d in range(12)]
    found = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    span = F.struct(F.lit(-1).alias("chunk_no"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("first_line"))
    found = found.withColumn("spans", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: span.withField("first_line", i.cast("int"))))
    sides = [sorted(map(tuple, L.repeated_windows(found, L.RUN_WORDS, by).collect())) for by in (None, False, True)]
    assert sides[0] == sides[1] == sides[2] and {r[0] for r in sides[0]} == set(range(1, 12))
    lines = spark.createDataFrame([(1, b"a"), (1, b"a"), (2, b"b"), (2, b"c"), (3, b"d")], L.LINE)
    assert [r.hash for r in L.shared_hashes(lines).collect()] == [2]


def test_parts_are_those_that_rows_have(spark):
    rows = spark.createDataFrame([(1, d, 5 * d, d % 3) for d in range(400)] + [(2, 7, 7, 7), (2, 8, 8, 8)], "g int, doc_id long, text_hash long, chunk_no int")
    at = L._every_part(rows.groupBy("g").agg(L._parts(L._salt()))).select("g", "part")
    assert sorted(map(tuple, at.collect())) == sorted(map(tuple, rows.select("g", L._salt().alias("part")).distinct().collect()))
    assert at.where("g = 1").count() > 60 and at.where("g = 2").count() <= 2
