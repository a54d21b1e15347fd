"""Sequence search: containment, shared words, local alignment, projection of annotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylolake.functions import sequence as S
from phylolake.operators.words import shared_words
from phylolake.session import ship_package, spread_work

# The BLOSUM62 matrix (Henikoff and Henikoff 1992) in half bits, lower triangle, and its usual gap costs.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
GAP_START, GAP_STEP = 11, 1
#: Half bits as 10 log10 of the odds, the scale on which the acceptance cut-offs 70, 80 and 1000 are stated.
UNIT = 5 * np.log10(2)
GAP_OPEN, GAP_EXTEND = -(GAP_START + GAP_STEP) * UNIT, -GAP_STEP * UNIT
EXACT_PER_RESIDUE = 5.0


def substring_rows(df: DataFrame, column: str, query: str, *, ignore_case: bool = True) -> DataFrame:
    """Rows whose text holds the query, with the number of (overlapping) occurrences; an empty query matches nothing."""
    c = F.lower(column) if ignore_case else F.col(column)
    q = query.lower() if ignore_case else query
    if not q:
        return df.where(F.lit(False)).withColumn("occurrences", F.lit(0))
    if not any(q.startswith(q[k:]) for k in range(1, len(q))):  # occurrences cannot overlap
        n = (F.length(c) - F.length(F.replace(c, F.lit(q), F.lit("")))) / len(q)
        return df.where(c.contains(q)).withColumn("occurrences", n.cast("int"))
    starts = F.filter(F.sequence(F.lit(1), F.length(c) - len(q) + 1), lambda i: F.substring(c, i, F.lit(len(q))) == q)
    return df.where(c.contains(q)).withColumn("occurrences", F.size(starts))


def exact_search(sequences: DataFrame, query: str, *, id_col: str = "seq_id", seq: str = "seq", full_length: bool = False, id_range: tuple[int, int] | None = None) -> DataFrame:
    """Sequences equal to the query or containing it; the id range is closed."""
    rows = sequences if id_range is None else sequences.where(F.col(id_col).between(*id_range))
    return rows.where(F.col(seq) == query if full_length else F.col(seq).contains(query)) if query else rows.where(F.lit(False))


def kmer_index(sequences: DataFrame, *, id_col: str = "seq_id", seq: str = "seq", k: int = 6) -> DataFrame:
    """(kmer, id): distinct words of every sequence."""
    return spread_work(sequences.select(id_col, seq)).select(F.col(id_col), F.explode(F.array_distinct(S.kmers(seq, k))).alias("kmer"))


def kmer_rank(queries: DataFrame, index: DataFrame, *, query_id: str = "query_id", query: str = "query", id_col: str = "seq_id", k: int = 6, coverage: float = 0.0) -> DataFrame:
    """(query_id, id, hits, coverage): words of each query, with repeats, that a sequence holds.

    Repeats of a word are counted before the join, so a query with a common word
    ships it once.
    """
    q = queries.select(query_id, F.explode(S.kmers(query, k)).alias("kmer")).groupBy(query_id, "kmer").agg(F.count(F.lit(1)).alias("w"))
    total = queries.select(query_id, (F.length(query) - (k - 1)).alias("total"))
    hits = q.join(index, "kmer").groupBy(query_id, id_col).agg(F.sum("w").alias("hits"))
    return hits.join(total, query_id).select(query_id, id_col, "hits", (F.col("hits") / F.col("total")).alias("coverage")).where(F.col("coverage") >= coverage)


def kmer_search(sequences: DataFrame, query: str, *, id_col: str = "seq_id", k: int = 6, coverage: float = 0.0, n: int | None = None) -> DataFrame:
    """Sequences by share of the query's words; the best ``n`` (None or not positive: all)."""
    q = sequences.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    out = kmer_rank(q, kmer_index(sequences, id_col=id_col, k=k), id_col=id_col, k=k, coverage=coverage).drop("query_id")
    return out if not n or n <= 0 else out.orderBy(F.desc("coverage"), id_col).limit(n)


def _exchange() -> np.ndarray:
    """Scores of residue pairs by character code; X and unknown characters score 0 against all."""
    m = np.zeros((128, 128))
    for a, row in zip(RESIDUES, BLOSUM62.split("\n")[1:-1], strict=True):
        for b, score in zip(RESIDUES, row.split(), strict=False):
            m[ord(a), ord(b)] = m[ord(b), ord(a)] = int(score) * UNIT
    return m


def local_alignment(a: str, b: str, exchange: np.ndarray | None = None) -> tuple[float, float]:
    """(score, identity of the aligned part) by Smith-Waterman with affine gaps, one row at a time."""
    if not a or not b:
        return 0.0, 0.0
    m = _exchange() if exchange is None else exchange
    x = np.frombuffer(a.encode("ascii", "replace"), np.uint8)
    y = np.frombuffer(b.encode("ascii", "replace"), np.uint8)
    n = len(y)
    h, hm, hl = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    e, em, el = np.full(n + 1, -1e9), np.zeros(n + 1), np.zeros(n + 1)
    best, at = (0.0, 0.0, 1.0), np.arange(n + 1)
    for c in x:
        opened = h + GAP_OPEN > e + GAP_EXTEND
        e, em, el = np.where(opened, h + GAP_OPEN, e + GAP_EXTEND), np.where(opened, hm, em), np.where(opened, hl, el) + 1
        d = h[:-1] + m[c, y]
        use_d = d >= e[1:]
        nh, nm, nl = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
        nh[1:] = np.where(use_d, d, e[1:])
        nm[1:] = np.where(use_d, hm[:-1] + (y == c), em[1:])
        nl[1:] = np.where(use_d, hl[:-1] + 1, el[1:])
        # a gap in this row opens at the best earlier cell; a gap after a gap never pays
        v = nh - GAP_EXTEND * at
        top = np.maximum.accumulate(v)
        origin = np.maximum.accumulate(np.where(v == top, at, 0))
        f = np.full(n + 1, -1e9)
        f[1:] = top[:-1] + GAP_OPEN + GAP_EXTEND * (at[1:] - 1)
        gap = f > nh
        if gap.any():
            k = origin[np.flatnonzero(gap) - 1]
            nm[gap], nl[gap] = nm[k], nl[k] + (at[gap] - k)
            nh = np.where(gap, f, nh)
        low = nh <= 0
        nh[low] = nm[low] = nl[low] = 0
        h, hm, hl = nh, nm, nl
        k = int(h.argmax())
        if h[k] > best[0]:
            best = (float(h[k]), float(hm[k]), float(hl[k]))
    return best[0], best[1] / best[2]


# One number per cell holds the score (upper 23 bits), the identical residues and the length (20 bits each), so that a maximum
# takes the best score, among equal ones the most identical residues, among these the shortest part.
_SCORE, _SAME, _LONGEST, _NONE = 1 << 40, 1 << 20, 1 << 18, -(1 << 60)
_PAD, _WIDTH, _CELLS = 128, 129, 2048


def _packed_exchange() -> np.ndarray:
    m = np.full((_WIDTH, _WIDTH), -(1 << 15), np.int64)
    m[:128, :128] = np.rint(_exchange() / UNIT)
    return (m * _SCORE + np.eye(_WIDTH, dtype=np.int64) * _SAME - 1).ravel()


def _align_batch(xs: list[bytes], ys: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and identities of many pairs at once, along the antidiagonals of their matrices; shorter ones are padded."""
    n, m, p = max(map(len, xs)), max(map(len, ys)), len(xs)
    x, y = np.full((n, p), _PAD, np.int64), np.full((m, p), _PAD, np.int64)
    for k, (a, b) in enumerate(zip(xs, ys, strict=True)):
        x[: len(a), k] = np.frombuffer(a, np.uint8)
        y[m - len(b) :, k] = np.frombuffer(b, np.uint8)[::-1]  # backwards, as an antidiagonal meets it
    x *= _WIDTH
    before, last, h = (np.zeros((n + 1, p), np.int64) for _ in range(3))
    up, up_new, left = (np.full((n + 1, p), _NONE, np.int64) for _ in range(3))
    best, t, u = np.zeros((n + 1, p), np.int64), np.empty((n, p), np.int64), np.empty((n, p), np.int64)
    opening, longer = -(GAP_START + GAP_STEP) * _SCORE - 1, -GAP_STEP * _SCORE - 1
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1) + 1
        here, above, a, b = slice(lo, hi), slice(lo - 1, hi - 1), t[: hi - lo], u[: hi - lo]
        np.add(x[above], y[m - d + lo : m - d + hi], out=a)
        table.take(a, out=b, mode="clip")
        b += before[above]
        np.add(up[above], longer, out=up_new[here])
        np.add(last[above], opening, out=a)
        np.maximum(up_new[here], a, out=up_new[here])
        np.maximum(b, up_new[here], out=b)
        left[here] += longer
        np.add(last[here], opening, out=a)
        np.maximum(left[here], a, out=left[here])
        np.maximum(b, left[here], out=b)
        np.multiply(b, b >= _SCORE // 2, out=h[here])  # a score of 0 or less begins anew
        np.maximum(best[here], h[here], out=best[here])
        before, last, h, up, up_new = last, h, before, up_new, up
    top = best.max(axis=0)
    length = -top % _SAME
    same, score = (top + length) // _SAME % _SAME, (top + length) // _SCORE
    return score * UNIT, same / np.maximum(length, 1)


def local_alignments(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(scores, identities) of many pairs, as :func:`local_alignment` gives them, in batches of similar lengths.

    Among alignments of equal score the one with the most identical residues counts, and the shortest of these.
    """
    score, identity = np.zeros(len(pairs)), np.zeros(len(pairs))
    coded = [((a or "").encode("ascii", "replace"), (b or "").encode("ascii", "replace")) for a, b in pairs]
    long = {k for k, c in enumerate(coded) if max(map(len, c)) > _LONGEST}
    for k in long:
        score[k], identity[k] = local_alignment(*pairs[k])
    order = sorted((k for k, (a, b) in enumerate(coded) if a and b and k not in long), key=lambda k: (len(coded[k][0]), len(coded[k][1])))
    table, at = _packed_exchange(), 0
    while at < len(order):
        size = max(4, _CELLS // len(coded[order[at]][0]))
        batch = sorted(order[at : at + 8 * size], key=lambda k: len(coded[k][1]))
        for i in range(0, len(batch), size):
            some = batch[i : i + size]
            score[some], identity[some] = _align_batch([coded[k][0] for k in some], [coded[k][1] for k in some], table)
        at += 8 * size
    return score, identity


def align_pairs(pairs: DataFrame, a: str, b: str, *, keep: list[str]) -> DataFrame:
    """``keep`` columns with alignment score and identity of two sequence columns."""
    ship_package(pairs.sparkSession)
    rest = pairs.select(*keep).schema

    def run(batches):
        for batch in batches:
            score, identity = local_alignments(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(score), pa.array(identity)], names=[*keep, "score", "identity"])

    schema = rest.add("score", "double").add("identity", "double")
    spread = pairs.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism)  # few rows, much work in each
    return spread.select(F.col(a).alias("__a"), F.col(b).alias("__b"), *keep).mapInArrow(run, schema)


def approximate_search(queries: DataFrame, sequences: DataFrame, *, query_id: str = "query_id", query: str = "query", id_col: str = "seq_id", seq: str = "seq", n: int = 50, k: int = 6, coverage: float = 0.0) -> DataFrame:
    """(query_id, id, coverage, score, identity): the best ``n`` sequences of every query by shared words, aligned."""
    ranked = shared_words(queries, sequences, query_id=query_id, query=query, id_col=id_col, seq=seq, k=k, coverage=coverage, n=n if n > 0 else None).drop("hits")
    if n > 0:
        w = Window.partitionBy(query_id).orderBy(F.desc("coverage"), id_col)
        ranked = ranked.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
    full = ranked.join(queries.select(query_id, F.col(query).alias("__q")), query_id).join(sequences.select(id_col, F.col(seq).alias("__s")), id_col)
    return align_pairs(full, "__q", "__s", keep=[query_id, id_col, "coverage"])


def sequence_search(queries: DataFrame, sequences: DataFrame, *, query_id: str = "query_id", query: str = "query", id_col: str = "seq_id", seq: str = "seq", n: int = 50) -> DataFrame:
    """(query_id, id, mode, score): exact hits tagged 'exact'; queries without any go through the approximate search."""
    q = queries.select(query_id, S.sanitise(query).alias("__q"))
    exact = q.where("__q <> ''").join(sequences.select(id_col, F.md5(seq).alias("__m")), F.md5("__q") == F.col("__m")).select(query_id, id_col, F.lit("exact").alias("mode"), (F.length("__q") * EXACT_PER_RESIDUE).alias("score"))
    rest = q.join(exact.select(query_id), query_id, "left_anti")
    approx = approximate_search(rest, sequences, query_id=query_id, query="__q", id_col=id_col, seq=seq, n=n)
    return exact.unionByName(approx.select(query_id, id_col, F.lit("approx").alias("mode"), "score"))


def best_hits(hits: DataFrame, *, query_id: str = "query_id", id_col: str = "seq_id", min_score: float = 70.0, share_of_best: float = 0.8, annotated: DataFrame | None = None) -> DataFrame:
    """The best acceptable hit of every query: score at least ``min_score`` and ``share_of_best`` of the
    query's maximum, annotated if ``annotated`` lists ids; exact hits always qualify and all stay."""
    top = F.max("score").over(Window.partitionBy(query_id))
    ok = hits.withColumn("__top", top).where((F.col("mode") == "exact") | ((F.col("score") >= min_score) & (F.col("score") >= share_of_best * F.col("__top"))))
    if annotated is not None:
        ok = ok.join(annotated.select(id_col).distinct(), id_col, "left_semi")
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return ok.withColumn("__r", F.row_number().over(w)).where((F.col("mode") == "exact") | (F.col("__r") == 1)).drop("__r", "__top")


def project_annotations(queries: DataFrame, sequences: DataFrame, annotations: DataFrame, *, query_id: str = "query_id", query: str = "query", id_col: str = "seq_id", seq: str = "seq", min_length: int = 25) -> DataFrame:
    """(query_id, term_nr, mode, via): annotations of the best annotated hit, distinct; short queries are skipped."""
    long_enough = queries.where(F.length(S.sanitise(query)) >= min_length)
    hits = best_hits(sequence_search(long_enough, sequences, query_id=query_id, query=query, id_col=id_col, seq=seq), query_id=query_id, id_col=id_col, annotated=annotations)
    return hits.join(annotations.select(id_col, "term_nr"), id_col).select(query_id, "term_nr", "mode", F.col(id_col).alias("via")).distinct()


def closest_sequences(queries: DataFrame, sequences: DataFrame, *, query_id: str = "query_id", query: str = "query", id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(query_id, id, mode, score): the closest sequence of every query, if close enough."""
    hits = sequence_search(queries, sequences, query_id=query_id, query=query, id_col=id_col, seq=seq)
    best = best_hits(hits, query_id=query_id, id_col=id_col, min_score=80.0, share_of_best=0.5)
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return best.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def remap_missing(missing: DataFrame, sequences: DataFrame, *, query_id: str = "query_id", query: str = "query", id_col: str = "seq_id", seq: str = "seq", min_score: float = 1000.0, min_identity: float = 0.8) -> DataFrame:
    """Hits good enough to stand for a record that went missing."""
    hits = approximate_search(missing, sequences, query_id=query_id, query=query, id_col=id_col, seq=seq)
    return hits.where((F.col("score") > min_score) & (F.col("identity") > min_identity))
