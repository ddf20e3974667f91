"""Ranked lexical search with a document FP-tree.

The items are the queries; a document keeps of its terms only those that some item has, as a vector of (term, tf) in order
of falling document frequency. Vectors that begin with the same terms share a path of a prefix tree. Every node
knows, of the documents below it, the largest tf of each term and the least m; as a term's score grows with tf and falls with m, these bound
the score of an item in the whole subtree. An item walks the tree depth first, the best bound first, and leaves out subtrees whose
bound is below its k-th score so far. Leaves hold a few neighbouring vectors, which are scored exactly. All scores and bounds are 64-bit integers, the bound is
never below a score, and ties are walked into, so the result is exact.

Documents are read twice: once for their vectors, which are written to the shared folder, and the corpus counts N, L and df, then
in blocks of about `block_entries` vector entries, each with a tree of its own. A task keeps the best k of each item over all its blocks and
passes on these alone. Documents of one vector and one m share their scores; of them the first k by doc_id are kept in a block, as no other
can be among the first k. The items come to the driver in parts of about `item_bytes` bytes of text, chosen by hash; more items mean more parts, each
of which is run over all documents.

Defined cases: a null, empty or term-less text is no document of N and is never returned; an item without known terms has no rows. Repeated rows are documents
of their own, a null doc_id comes last among equal scores. Items of equal item_id and text are one item. A very long text is one vector, as long as the
terms of the items at most. No documents or no items give no rows. Only doc_id and text, item_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from weekwatch.llm.registry import query, table
from weekwatch.llm.shared import store

TOP, BLOCK_ENTRIES, LEAF, ITEM_BYTES = 10, 1_000_000, 32, 8 << 20
B, SCALE = 75, 1_000_000_000
#: A-Z lowered, digits, letters and all bytes beyond ASCII kept, all else white space
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and other characters beyond ASCII, only A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def impact(tf, m):
    """Of one term, without its weight; grows with tf, falls with m."""
    return SCALE * tf // (1000 * tf + 8 * m)


# --- vectors -----------------------------------------------------------------------------------------


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): one row per document with a term; terms are those of the vocabulary, by number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"]):
                found = terms_of(text if isinstance(text, str) else None)
                if found:
                    known = [k for k in map(vocabulary.get, found) if k is not None]
                    rows.append((doc_id, len(found), *np.unique(np.array(known, np.int32), return_counts=True)))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"], dtype=object)
            yield out.astype({"n": "int64"})

    # ids travel as text: whole numbers with gaps would come as rounded floats
    cols = [F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*cols).mapInPandas(run, "doc_id string, n long, terms array<int>, tfs array<int>")


# --- the tree of a block -----------------------------------------------------------------------------


class Tree:
    """Prefix tree of documents [(doc_id, m, ranks, tfs)], ranks rising; node 0 is the root."""

    def __init__(self, docs: list[tuple], leaf: int = LEAF):
        docs = sorted(docs, key=lambda d: (d[2].astype(">u4").tobytes(), d[1]))
        self.ids, lengths = [d[0] for d in docs], np.array([len(d[2]) for d in docs], np.int64)
        self.at = np.r_[0, np.cumsum(lengths)]  # entries of document i: at[i] to at[i + 1]
        self.terms = np.concatenate([d[2] for d in docs]).astype(np.int64)
        tfs, m = np.concatenate([d[3] for d in docs]).astype(np.int64), np.array([d[1] for d in docs], np.int64)
        self.impacts = impact(tfs, np.repeat(m, lengths))
        self._grow(self._common(docs), leaf)
        self._bounds(tfs, m, np.repeat(np.arange(len(docs)), lengths))

    @staticmethod
    def _common(docs: list[tuple]) -> np.ndarray:
        """Length of the common path of each document and the next."""
        out = np.zeros(max(len(docs) - 1, 0), np.int64)
        for i in range(len(out)):
            x, y = docs[i][2], docs[i + 1][2]
            k = min(len(x), len(y))
            apart = np.flatnonzero(x[:k] != y[:k])
            out[i] = apart[0] if len(apart) else k
        return out

    def _grow(self, common: np.ndarray, leaf: int) -> None:
        """Nodes as ranges of documents: a range parts where its neighbours share no more than the path to the node."""
        self.low, self.high, self.parent, self.level, self.children = [0], [len(self.ids)], [-1], [0], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            lo, hi = self.low[node], self.high[node]
            if hi - lo <= leaf:
                continue
            inner = common[lo : hi - 1]
            cuts = [lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi]
            parts, start = [], cuts[0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                # small neighbours share a leaf
                if start < a and b - start > leaf:
                    parts.append((start, a))
                    start = a
            parts.append((start, hi))
            for a, b in parts:
                self.low.append(a)
                self.high.append(b)
                self.parent.append(node)
                self.level.append(self.level[node] + 1)
                self.children.append([])
                self.children[node].append(len(self.low) - 1)
                todo.append(len(self.low) - 1)

    def _bounds(self, tfs: np.ndarray, m: np.ndarray, doc: np.ndarray) -> None:
        """The largest tf of each term and the least m below every node, as impacts by term."""
        nodes, level, parent = len(self.low), np.array(self.level), np.array(self.parent)
        leaves = np.array([i for i in range(nodes) if not self.children[i]])
        leaves = leaves[np.argsort(np.array(self.low)[leaves])]
        leaf_of = np.repeat(leaves, np.array(self.high)[leaves] - np.array(self.low)[leaves])
        least = np.full(nodes, np.iinfo(np.int64).max)
        np.minimum.at(least, leaf_of, m)
        node, term, tf = _largest(leaf_of[doc], self.terms, tfs)
        parts, depth = [], level[node]
        up = (np.zeros(0, np.int64),) * 3
        for d in range(int(level.max()), -1, -1):
            here = depth == d
            up = _largest(*(np.r_[a, b[here]] for a, b in zip(up, (node, term, tf))))
            parts.append(up)
            if d:
                at = np.flatnonzero(level == d)
                np.minimum.at(least, parent[at], least[at])
                up = (parent[up[0]], up[1], up[2])
        node, term, tf = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(term, kind="stable")
        self.nodes, self.bounds = node[order], impact(tf, least[node])[order]
        names, starts = np.unique(term[order], return_index=True)
        self.slices = {int(t): slice(a, b) for t, a, b in zip(names, starts, [*starts[1:], len(term)])}

    def search(self, item: list[tuple[int, int]], weights: np.ndarray, best: list[tuple], top: int) -> None:
        """Puts the best `top` (-score, id is null, id) of an item [(rank, weight)] into the sorted list `best`."""
        bound = np.zeros(len(self.low), np.int64)
        for rank, weight in item:
            if rank in self.slices:
                at = self.slices[rank]
                bound[self.nodes[at]] += weight * self.bounds[at]
                weights[rank] = weight
        stack = [0]
        while stack:
            node = stack.pop()
            least = -best[top - 1][0] if len(best) >= top else 1
            if bound[node] < least or bound[node] == 0:
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bound.__getitem__)
                continue
            lo, hi = self.low[node], self.high[node]
            a, b = self.at[lo], self.at[hi]
            scores = np.add.reduceat(weights[self.terms[a:b]] * self.impacts[a:b], self.at[lo:hi] - a)
            for i in np.flatnonzero(scores >= least):
                doc = self.ids[lo + i]
                insort(best, (-int(scores[i]), doc is None, doc or 0))
            del best[top:]
        for rank, _ in item:
            weights[rank] = 0


def _largest(node: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest tf of each (node, term)."""
    if not len(node):
        return node, term, tf
    order = np.lexsort((term, node))
    node, term, tf = node[order], term[order], tf[order]
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])])
    return node[first], term[first], np.maximum.reduceat(tf, first)


def _merged(docs: dict[tuple, list], top: int) -> list[tuple]:
    """Documents of one vector and one m: the first `top` by id."""
    out = []
    for (m, ranks, tfs), ids in docs.items():
        r, t = np.frombuffer(ranks, np.int32), np.frombuffer(tfs, np.int32)
        out += [(i, m, r, t) for i in sorted(ids, key=lambda i: (i is None, i or 0))[:top]]
    return out


def best_of(vecs: DataFrame, items: list[tuple], rank_of: np.ndarray, n_docs: int, n_terms: int, top: int = TOP, block_entries: int = BLOCK_ENTRIES, leaf: int = LEAF) -> DataFrame:
    """(item_no, item_id, doc_id, score): the best `top` of each item [(item_no, item_id, [(rank, weight)])] in each task's documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple]] = [[] for _ in items]
        weights = np.zeros(len(rank_of), np.int64)
        held: dict[tuple, list] = defaultdict(list)
        entries = 0

        def flush() -> None:
            tree = Tree(_merged(held, top), leaf)
            for (_, _, wanted), b in zip(items, best):
                tree.search(wanted, weights, b, top)

        for f in frames:
            for doc_id, n, terms, tfs in zip(f["doc_id"], f["n"], f["terms"], f["tfs"]):
                ranks = rank_of[terms]
                order = np.argsort(ranks)
                m = 100 - B + B * int(n) * n_docs // n_terms
                held[m, ranks[order].astype(np.int32).tobytes(), tfs[order].astype(np.int32).tobytes()].append(None if doc_id is None else int(doc_id))
                entries += len(terms) + 1
                if entries >= block_entries:
                    flush()
                    held.clear()
                    entries = 0
        if held:
            flush()
        rows = [(no, item_id, None if null else str(doc), -score) for (no, item_id, _), b in zip(items, best) for score, null, doc in b]
        yield pd.DataFrame(rows, columns=["item_no", "item_id", "doc_id", "score"], dtype=object).astype({"item_no": "int32", "score": "int64"})

    known = vecs.where(F.size("terms") > 0)
    return known.mapInPandas(run, "item_no int, item_id string, doc_id string, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_entries: int = BLOCK_ENTRIES, leaf: int = LEAF, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item (item_id, text) with the highest scores above 0."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    parts = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / item_bytes))
    found = [_search_part(docs, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i), top, block_entries, leaf) for i in range(parts)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_part(docs: DataFrame, asked: DataFrame, top: int, block_entries: int, leaf: int) -> DataFrame:
    # about item_bytes of text
    rows = asked.orderBy("item_id", "text").collect()
    counts = [Counter(terms_of(r["text"])) for r in rows]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    vecs = store(vectors(docs, vocabulary))
    # one row per term of the items
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in vecs.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = n
    n_docs, n_terms = vecs.agg(F.count("*"), F.sum("n")).first()
    rank_of = np.empty(len(df), np.int64)
    rank_of[np.argsort(-df, kind="stable")] = np.arange(len(df))

    def weight(term: int) -> int:
        return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[term]) + 1)))

    wanted = [
        (no, None if r["item_id"] is None else str(r["item_id"]), [(int(rank_of[vocabulary[t]]), k * weight(vocabulary[t])) for t, k in c.items()])
        for no, (r, c) in enumerate(zip(rows, counts))
    ]
    found = best_of(vecs, wanted, rank_of, n_docs, n_terms, top, block_entries, leaf)
    found = found.select("item_no", F.col("item_id").cast("long").alias("item_id"), F.col("doc_id").cast("long").alias("doc_id"), "score")
    rank = F.row_number().over(W.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PATTERN}') as w from documents),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PATTERN}')) as term from benchmark),
c as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as n_terms from d where len(w) > 0),
tf as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) where term in (select term from i) group by r, term),
df as (select term, count(*) as df from tf group by term),
q as (select item_id, term, count(*) * cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as weight from i join df using (term), c group by item_id, term, n_docs, df),
m as (select r, doc_id, 100 - 75 + ((75 * len(w) * n_docs) // n_terms) as m from d, c),
s as (select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
      from q join tf using (term) join m using (r) group by item_id, r, doc_id),
k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= {TOP}"""


@query("op11_lexical_search", SQL)
def op11(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
