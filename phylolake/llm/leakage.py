"""Held-out passages inside a training corpus, found with one FM-index per shard of documents.

The words of the passages are the alphabet; every other word of a document is one
further symbol. All runs of ``SEED`` words of the passages are searched backwards
in the index of each shard, located, and collected per document, passage and
diagonal. A cheap bound on the matching words around a hit removes shared
phrasing; what is left is aligned exactly inside a band and judged by the number
of running words of the passage, the part of them that is intact, and whether the
words that tell this passage from others are among those.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylolake.llm import text as T
from phylolake.llm.fm_index import FMIndex
from phylolake.session import ship_package, spill, spread_work

SEED = 5  # 20 words with 3 of them wrong still hold an intact run of 5
BAND = 8  # words inserted or dropped before an alignment leaves its diagonal
EDGE = 6  # 20 words with 2 of them wrong lose at most 6 at the ends of a local alignment
TELLING_SHARE = 0.02  # words of at most this share of the items (one item at least) tell a passage from shared phrasing
GAP, OTHER = 0, 1  # symbols: between documents, and any word no passage has


def forms(passage: str | None) -> list[list[tuple[str, int]]]:
    """The words of a passage with the number of the written word each belongs to: as they are, and with the parts of a written word run together."""
    parts = [T.words(w) for w in T.readable(passage or "").split()]
    parts = [p for p in parts if p]
    apart = [(w, k) for k, p in enumerate(parts) for w in p]
    joined = [("".join(p), k) for k, p in enumerate(parts)]
    return [apart, joined] if apart != joined else [apart]


def common_words(items: DataFrame) -> frozenset[str]:
    """Words of more than ``TELLING_SHARE`` of all items (i, p), and of more than one.

    At most 1 / ``TELLING_SHARE`` times the mean number of words of an item come to the driver, however many items there are.
    """

    def words(batches):
        for b in batches:
            own = [(w, i) for i, p in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in sorted({w for form in forms(p) for w, _ in form})]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([i for _, i in own], b.schema.field(0).type)], names=["w", "i"])

    kind = dict(items.dtypes)["i"]
    n = items.select("i").distinct().count()
    held = items.mapInArrow(words, f"w string, i {kind}").groupBy("w").agg(F.countDistinct("i").alias("n"))
    return frozenset(r[0] for r in held.where(F.col("n") > max(1, int(n * TELLING_SHARE))).select("w").toLocalIterator())


class Passages:
    """The searched side: passages as word numbers. Each passage is held as it is and, for texts that
    lost all punctuation, with the parts of every written word run together."""

    def __init__(self, items, common=frozenset()):
        """``common`` are the words of too many items to tell a passage from others."""
        self.number = {}
        self.item, self.word, self.written = [], [], []
        for item, passage in items:
            for form in forms(passage):
                if form:
                    self.item.append(item)
                    self.word.append(np.array([self.number.setdefault(w, len(self.number) + 2) for w, _ in form], np.int64))
                    self.written.append(np.array([k for _, k in form], np.int64))
        self.length = np.array([len(w) for w in self.word], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.all = np.concatenate(self.word) if self.word else np.zeros(0, np.int64)
        self.telling = np.array([True, True] + [w not in common for w in self.number])
        seeds = [(v, k) for v, w in enumerate(self.word) for k in range(len(w) - SEED + 1)]
        self.seed_of = np.array(seeds, np.int64).reshape(-1, 2)
        grams = np.stack([self.word[v][k : k + SEED] for v, k in seeds]) if seeds else np.zeros((0, SEED), np.int64)
        self.grams, at = np.unique(grams, axis=0, return_inverse=True) if seeds else (grams, np.zeros(0, np.int64))
        by = np.argsort(at.ravel(), kind="stable")
        self.seed_of = self.seed_of[by]
        self.seed_start = np.concatenate([[0], np.cumsum(np.bincount(at.ravel(), minlength=len(self.grams)))]).astype(np.int64)

    def symbols(self, words: list[str]) -> list[int]:
        get = self.number.get
        return [get(w, OTHER) for w in words]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+count."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _align(doc: np.ndarray, base: np.ndarray, limit: np.ndarray, P: Passages, v: np.ndarray, diag: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Best local alignment of each candidate inside its band: (score, first and last passage word, intact words, last and first doc word).

    Passage words outside [start, stop) are left out.

    An intact word scores 1, a replaced, dropped or inserted one -2. All candidates advance together.
    """
    n, width = len(v), 2 * BAND + 1
    score, begin, hits, origin = np.zeros((n, width + 1)), np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
    best, found = np.zeros(n), np.zeros((n, 5), np.int64)
    place, rows = np.arange(width), np.arange(n)
    bonus = 2.0 * place
    for j in range(int(start.min()), int(stop.max())):
        inside = (j >= start) & (j < stop)
        word = P.all[np.minimum(P.start[v] + j, len(P.all) - 1)]
        d = (diag + j - BAND)[:, None] + place
        ok = inside[:, None] & (d >= 0) & (d < limit[:, None])
        same = ok & (doc[np.clip(base[:, None] + d, 0, len(doc) - 1)] == word[:, None])
        old = score[:, :-1]
        s, b, h = old + np.where(same, 1.0, -2.0), np.where(old > 0, begin[:, :-1], j), hits[:, :-1] + same
        f = np.where(old > 0, origin[:, :-1], d)
        up = score[:, 1:] - 2.0  # the passage word is missing in the text
        take = up > s
        s, b, h, f = np.where(take, up, s), np.where(take, begin[:, 1:], b), np.where(take, hits[:, 1:], h), np.where(take, origin[:, 1:], f)
        # words the text has in addition: every place takes the best of those before it, less 2 a word
        lifted = np.where(ok, s, -np.inf) + bonus
        top = np.maximum.accumulate(lifted, axis=1)
        at = np.maximum.accumulate(np.where(lifted == top, place, 0), axis=1)
        s = top - bonus
        alive = ok & (s > 0)
        score[:, :-1] = np.where(alive, s, 0.0)
        begin[:, :-1] = np.where(alive, np.take_along_axis(b, at, 1), j)
        hits[:, :-1] = np.where(alive, np.take_along_axis(h, at, 1), 0)
        origin[:, :-1] = np.take_along_axis(f, at, 1)
        m = score[:, :-1].argmax(1)
        better = score[rows, m] > best
        if better.any():
            r, m = rows[better], m[better]
            best[r] = score[r, m]
            found[r] = np.stack([begin[r, m], np.full(len(r), j), hits[r, m], d[r, m], origin[r, m]], 1)
    return best, found


def _beyond(words: np.ndarray, text: np.ndarray):
    """Per number of passage words past an end of an alignment: (wrong words, text words used, whether the last one is intact)."""
    n, m = min(len(words), EDGE), min(len(text), EDGE + 2)
    cost = np.arange(m + 1)
    out = [(0, 0, True)]
    for i in range(n):
        new = np.full(m + 1, i + 1)
        for j in range(m):
            new[j + 1] = min(cost[j] + (words[i] != text[j]), cost[j + 1] + 1, new[j] + 1)
        used = int(new.argmin())
        out.append((int(new[used]), used, used > 0 and words[i] == text[used - 1]))
        cost = new
    return out


def _widen(words: np.ndarray, written: np.ndarray, text: np.ndarray, b: int, e: int, intact: int, first: int, last: int, wrong_part: float, ends: bool):
    """The alignment carried on over wrong words at its ends while their share stays within ``wrong_part``: (b, e, first, last).

    With ``ends`` it stops at intact words.
    """
    left, right = _beyond(words[:b][::-1], text[:first][::-1]), _beyond(words[e + 1 :], text[last + 1 :])
    wrong, best = e - b + 1 - intact, (written[e] - written[b] + 1, 0, b, e, first, last)
    for i, (wl, ul, il) in enumerate(left):
        for k, (wr, ur, ir) in enumerate(right):
            if (not ends or (il and ir)) and wrong + wl + wr <= wrong_part * (e - b + 1 + i + k):
                best = max(best, (written[e + k] - written[b - i] + 1, -wl - wr, b - i, e + k, first - ul, last + ur))
    return best[2:]


def _windows(words: np.ndarray, written: np.ndarray, text: np.ndarray, b: int, e: int, first: int, last: int, running: int, wrong_part: float):
    """Parts of an alignment with too many wrong words that have few enough by themselves: (b, e, first, last)."""
    place = np.full(e - b + 1, -1)
    for x, y, size in SequenceMatcher(None, words[b : e + 1].tolist(), text[first : last + 1].tolist(), autojunk=False).get_matching_blocks():
        place[x : x + size] = np.arange(y, y + size) + first
    ok = place >= 0
    parts = []
    for x in np.flatnonzero(ok):
        y = int(np.searchsorted(written[b : e + 1], written[b + x] + running))
        if written[b + y - 1] - written[b + x] + 1 >= running and (~ok[x:y]).sum() <= int(running * wrong_part):
            y = x + np.flatnonzero(ok[x:y])[-1]
            if parts and x <= parts[-1][1]:
                parts[-1][1] = max(parts[-1][1], y)
            else:
                parts.append([x, y])
    return [(b + int(x), b + int(y), int(place[x]), int(place[y])) for x, y in parts]


def _search_shard(ids, lengths, symbols, P: Passages, least_words: int, intact: float, running: int, wrong_part: float):
    """Rows (doc, item, first and last word in the document) of one shard."""
    text = np.array(symbols, np.int64)
    lengths = np.array(lengths, np.int64)
    base = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    index = FMIndex(text, len(P.number) + 2)
    lo, hi = index.search(P.grams)
    seen = np.flatnonzero(hi > lo)
    if not len(seen):
        return []
    counts = (hi - lo)[seen]
    where = index.locate(_spread(lo[seen], counts))
    gram = np.repeat(seen, counts)
    many = P.seed_start[gram + 1] - P.seed_start[gram]
    at = np.repeat(where, many)
    seed = P.seed_of[_spread(P.seed_start[gram], many)]
    doc = np.searchsorted(base, at, side="right") - 1
    v, k = seed[:, 0], seed[:, 1]
    diag = at - base[doc] - k
    # one candidate per document, passage and stretch of nearby diagonals and passage words
    order = np.lexsort((k, diag, v, doc))
    doc, v, k, diag = doc[order], v[order], k[order], diag[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (diag[1:] != diag[:-1]) | (k[1:] - k[:-1] > SEED)
    doc, v, k, diag = doc[fresh], v[fresh], k[fresh], diag[fresh]
    # bound: passage words around the hit that occur near their place in the text
    rows = []
    reach = 24
    span = np.arange(-reach, reach + SEED + 1)
    for a in range(0, len(doc), 20_000):
        d_, v_, k_, g_ = doc[a : a + 20_000], v[a : a + 20_000], k[a : a + 20_000], diag[a : a + 20_000]
        j = k_[:, None] + span
        inside = (j >= 0) & (j < P.length[v_][:, None])
        word = np.where(inside, P.all[np.clip(P.start[v_][:, None] + j, 0, len(P.all) - 1)], -1)
        near = np.zeros(j.shape, bool)
        for shift in range(-4, 5):
            p = g_[:, None] + j + shift
            ok = (p >= 0) & (p < lengths[d_][:, None])
            near |= ok & (text[np.clip(base[d_][:, None] + p, 0, len(text) - 1)] == word)
        total = np.concatenate([np.zeros((len(d_), 1), np.int64), np.cumsum(near, 1)], 1)
        window = 20
        most = (total[:, window:] - total[:, :-window]).max(1)
        kept = most >= int(window * 0.7)
        if kept.any():
            rows.append(np.stack([d_[kept], v_[kept], g_[kept]], 1))
    if not rows:
        return []
    cand = np.unique(np.concatenate(rows), axis=0)
    # neighbouring diagonals share a band
    keep = np.ones(len(cand), bool)
    for i in range(1, len(cand)):
        p = cand[i - 1]
        if cand[i, 0] == p[0] and cand[i, 1] == p[1] and cand[i, 2] - p[2] <= 2 and keep[i - 1]:
            keep[i] = False
    cand = cand[keep]
    out = {}
    # every alignment of a band, not the best alone: what lies before and behind one is aligned again
    todo = np.concatenate([cand, np.zeros((len(cand), 1), np.int64), P.length[cand[:, 1]][:, None]], 1)
    shortest = running - EDGE
    while len(todo):
        rest = []
        for a in range(0, len(todo), 4000):
            c = todo[a : a + 4000]
            best, found = _align(text, base[c[:, 0]], lengths[c[:, 0]], P, c[:, 1], c[:, 2], c[:, 3], c[:, 4])
            for (d, pv, g, lo, hi), s, (b, e, h, last, first) in zip(c.tolist(), best.tolist(), found.tolist(), strict=True):
                if s <= 0:
                    continue
                rest += [(d, pv, g, x, y) for x, y in ((lo, b), (e + 1, hi)) if y - x >= shortest]
                w, words, own = P.written[pv], P.word[pv], text[base[d] : base[d] + lengths[d]]
                if w[e] - w[b] + 1 < shortest:
                    continue
                if w[e] - w[b] + 1 >= least_words and h >= intact * (e - b + 1):
                    parts = [_widen(words, w, own, b, e, h, first, last, wrong_part, True)]
                elif h < intact * (e - b + 1):
                    parts = _windows(words, w, own, b, e, first, last, running, wrong_part)
                else:
                    wide = _widen(words, w, own, b, e, h, first, last, wrong_part, False)
                    parts = [wide] if w[wide[1]] - w[wide[0]] + 1 >= running else []
                for b, e, first, last in parts:
                    part = words[b : e + 1]
                    telling = part[P.telling[part]]
                    if len(telling) and np.isin(telling, own[max(0, last - (e - b) - BAND) : last + 1]).mean() < 0.6:
                        continue  # shared phrasing around other names and numbers
                    out.setdefault((ids[d], P.item[pv]), []).append((int(first), int(last)))
        todo = np.array(rest, np.int64).reshape(-1, 5)
    rows = []
    for key, spans in out.items():
        merged = []
        for first, last in sorted(spans):
            if merged and first <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        rows += [(*key, *span) for span in merged]
    return rows


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    running_words: int = 20,
    wrong_part: float = 0.125,
    shard_words: int = 400_000,
    max_item_words: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, first_word, last_word) of every quote of a passage, in whole or part; a document with several has a row for each.

    A part counts from ``running_words`` running words of the passage on, of which a share of about
    ``wrong_part`` may be replaced, misspelt or dropped, also at both ends of the part. Case, punctuation, layout, markup, look-alike
    characters and wrong decodings do not matter. The word span refers to the
    document's cleaned words.

    The passages travel to every task in blocks of at most ``max_item_words`` words (or one longer passage), one pass over the documents for each
    block; which words tell passages apart is decided over all items. Documents stream through shards of ``shard_words`` words; a
    longer text is a shard of its own. Null or empty texts and passages match
    nothing; repeated items count once; null ids are ignored.
    """
    ship_package(docs.sparkSession)
    small = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).alias("i"), F.col(passage).alias("p")).distinct()
    common = common_words(small)
    least = running_words - int(running_words * wrong_part)
    intact = 1 - wrong_part * 1.6
    schema = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32())])

    def search(batches, block):
        P, ids, lengths, symbols = Passages(*block), [], [], []

        def flush():
            rows = _search_shard(ids, lengths, symbols, P, least, intact, running_words, wrong_part) if len(P.grams) and symbols else []
            ids.clear(), lengths.clear(), symbols.clear()
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = P.symbols(T.words(t))
                if len(s) < SEED:
                    continue
                ids.append(i), lengths.append(len(s))
                symbols.extend(s)
                symbols.append(GAP)
                if len(symbols) >= shard_words:
                    yield flush()
        yield flush()

    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint"), F.col(text))

    def pass_over(block):
        held = docs.sparkSession.sparkContext.broadcast((block, common))
        found = spread_work(rows).mapInArrow(lambda batches: search(batches, held.value), "doc bigint, item bigint, first_word int, last_word int")
        return held, found.toDF("doc_id", "item_id", "first_word", "last_word").distinct()

    block, size, done = [], 0, []
    for r in small.orderBy("i", "p").toLocalIterator():
        n = len(r["p"].split())
        if block and size + n > max_item_words:
            held, found = pass_over(block)
            done.append(spill(found, "leaks"))  # before the next block is read
            held.unpersist()
            block, size = [], 0
        block.append((r["i"], r["p"]))
        size += n
    out = pass_over(block)[1]
    for part in done:
        out = out.unionByName(part)
    return out


def removal_spans(leaks: DataFrame) -> DataFrame:
    """(doc_id, first_word, last_word, n_items): overlapping or touching spans of a document merged."""
    w = Window.partitionBy("doc_id").orderBy("first_word", "last_word")
    before = F.max("last_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = leaks.withColumn("__new", F.when(before.isNull() | (F.col("first_word") > before + 1), 1).otherwise(0))
    return (
        opened.withColumn("__span", F.sum("__new").over(w))
        .groupBy("doc_id", "__span")
        .agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.countDistinct("item_id").alias("n_items"))
        .drop("__span")
    )
