"""Mixtures of sources at target shares of the total token count."""

from __future__ import annotations

import math
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylolake.errors import BoundExceeded
from phylolake.session import ship_package, spill, spread_work

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BINS = 4096  # the fractional pass of a source is cut at one of this many hash bins


def token_counts(df: DataFrame, text: str, tokenizer: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """``df`` without ``text`` and with the number of tokens of it; null and empty texts have 0.

    ``tokenizer`` is the path of a public tokenizer file (json of the tokenizers
    library) that every executor can read. Whole texts are encoded; strings of
    special tokens inside a text are ordinary text.
    """
    rest = [c for c in df.columns if c not in (text, name)]
    schema = df.select(*rest).schema.add(name, "long")
    ship_package(df.sparkSession)

    def count(batches):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(Path(tokenizer).read_text(encoding="utf-8"))
        tok.encode_special_tokens = True
        for batch in batches:
            n, texts = [], batch.column(0).to_pylist()
            for lo in range(0, len(texts), 256):
                n += [len(e.ids) for e in tok.encode_batch([t or "" for t in texts[lo : lo + 256]], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*rest, name])

    return spread_work(df.select(text, *rest)).mapInArrow(count, schema)


def source_key(col) -> Column:
    """Sources equal but for case and blanks around them are one; blank becomes null."""
    c = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    return F.when(c != "", c)


def water_fill(targets: dict[str, tuple[float, int]], available: dict[str, int], budget: int | None = None) -> dict[str, float]:
    """Tokens to take per source.

    ``targets`` maps a source to (share, largest number of passes). A source can give at
    most ``passes * available`` tokens. Sources that would need more are clamped
    there, and what they lack goes to the others in proportion to their shares, again
    and again until all fit. Without ``budget`` the total is what one pass over the
    wanted sources holds; a total beyond all caps is lowered to their sum.
    """
    cap = {s: float(max(0, passes) * available.get(s, 0)) for s, (share, passes) in targets.items() if share > 0}
    total = float(budget if budget is not None else sum(available.get(s, 0) for s in cap))
    left, open_, taken = min(total, sum(cap.values())), set(cap), dict.fromkeys(targets, 0.0)
    while open_ and left > 1e-9:
        weight = sum(targets[s][0] for s in open_)
        full = [s for s in open_ if left * targets[s][0] / weight >= cap[s]]
        if not full:
            taken |= {s: left * targets[s][0] / weight for s in open_}
            break
        for s in full:
            taken[s] = cap[s]
        left -= sum(cap[s] for s in full)
        open_ -= set(full)
    return taken


def _cuts(mass: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut, tokens): the bins below ``cut`` come nearest to the tokens wanted of a further pass; no row where none is taken."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = mass.withColumn("before", before).join(wanted.where("want > 0"), "source").where(F.col("before") + F.col("n") / 2 <= F.col("want"))
    return near.groupBy("source").agg((F.max("bin") + 1).alias("cut"), F.max(F.col("before") + F.col("n")).alias("tokens"))


class Mixture:
    """The plan of one mixture: ``records`` (id, source, n_tokens, repeats) and ``shares`` per source."""

    def __init__(self, records: DataFrame, shares: DataFrame):
        self.records, self.shares = records, shares


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    target_name: str = "source_name",
    target_share: str = "target_share",
    target_repeats: str = "max_repeats",
    budget: int | None = None,
    seed: int = 42,
    tokenizer: str = TOKENIZER,
    max_sources: int = 1_000_000,
) -> Mixture:
    """Choose how often every record is used so that the sources reach their target shares.

    A source is used in whole passes plus a seeded part of one more: the records
    whose hash falls below a cut. The cut is chosen from a histogram of the tokens
    over ``BINS`` hash bins per source, so the realised share misses the plan by about one bin
    of one pass at most. Records without a source, of a source without a target, or
    of an unwanted one (share null or 0) are left out; a wanted source without
    records gets nothing and its weight goes to the others; targets named twice
    are added up, with the larger number of passes. Empty texts weigh nothing and
    follow their source.

    The targets are read to the driver after a check against ``max_sources``.
    """
    t = targets.select(source_key(target_name).alias("s"), F.coalesce(target_share, F.lit(0.0)).alias("w"), F.coalesce(target_repeats, F.lit(0)).alias("m"))
    rows = t.where("s IS NOT NULL").groupBy("s").agg(F.sum("w"), F.max("m")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise BoundExceeded(f"more than {max_sources} target sources")
    goal = {s: (float(w), int(m)) for s, w, m in rows}
    counted = token_counts(docs.select(F.col(id_col).alias("id"), source_key(source).alias("source"), F.col(text).alias("text")), "text", tokenizer)
    bin_ = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(BINS)).cast("int")
    counted = spill(counted.where(F.col("source").isin(*goal) if goal else F.lit(False)).withColumn("bin", bin_), "tokens")
    mass = spill(counted.groupBy("source", "bin").agg(F.sum("n_tokens").alias("n")), "mass")
    available = {s: n or 0 for s, n in mass.groupBy("source").agg(F.sum("n")).collect()}  # one number per target source
    taken = water_fill(goal, available, budget)
    plan, spark = [], docs.sparkSession
    for s, (share, passes) in goal.items():
        have = available.get(s, 0)
        epochs = taken[s] / have if have else 0.0
        whole = min(math.floor(epochs + 1e-12), passes)
        want = (epochs - whole) * have if whole < passes else 0.0
        plan.append((s, share, passes, have, taken[s], whole, want))
    cuts = _cuts(mass, spark.createDataFrame([(p[0], p[6]) for p in plan], "source string, want double"))
    partly = {s: (cut, got) for s, cut, got in cuts.collect()}  # one row per target source
    plan = [(*p[:6], partly.get(p[0], (0, 0))[0], p[5] * p[3] + partly.get(p[0], (0, 0))[1]) for p in plan]
    used = sum(p[7] for p in plan)
    wanted = sum(share for share, _ in goal.values()) or 1.0
    shares = spark.createDataFrame(
        [(s, share, passes, have, round(want / have, 6) if have else 0.0, n, round(share / wanted, 6), round(n / used, 6) if used else 0.0) for s, share, passes, have, want, _, _, n in plan],
        "source string, target_share double, max_repeats int, available_tokens bigint, epochs double, used_tokens bigint, wanted_share double, actual_share double",
    )
    cuts = spark.createDataFrame([(p[0], p[5], p[6]) for p in plan], "source string, whole int, cut int")
    repeats = F.col("whole") + F.when(F.col("bin") < F.col("cut"), 1).otherwise(0)
    records = counted.join(F.broadcast(cuts), "source").select("id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")
    return Mixture(records, shares)
