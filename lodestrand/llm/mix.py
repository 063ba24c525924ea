"""Mixing sources to target weights.

Method: subset-sum budget fitting.

1. Documents are counted in tokens of a public tokenizer, then per source and exact
   token length (a histogram as long as there are different lengths).
2. The total is the largest at which every source with documents can give its share
   within its repeats (or the one asked for). Targets of sources without documents
   can't be met; the others are scaled to add up to 1 and both figures are reported.
3. A source's budget takes whole rounds of all its documents; the rest is spread over
   the lengths in proportion, and what rounding leaves is fitted by a bounded-knapsack
   dynamic programme over the lengths not yet used up, with bit sets for reachable sums.
4. How many documents of each length are taken is then met by documents in seeded
   order: whole buckets of the hash first, a ranking only within the one bucket where
   the count ends. No task ranks a source or a length.

Defined cases: null and empty texts have no tokens and are never selected; a null source
has no target; sources that no target names are left out; spellings differing in case,
hyphens and blanks are one source; a budget that no subset meets is met as nearly as
possible from below or above; empty tables give no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.tables import cut

TOKENIZER = os.environ.get("LODESTRAND_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
SEED = 11
BUCKETS = 256
SMOOTH = 64  # lengths of one document each that the programme may still choose from


def united(col) -> F.Column:
    """One spelling of a source."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s\-_]+", "_")


_LOADED: dict[str, object] = {}


def _count(texts: list[str], path: str) -> list[int]:
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _LOADED[path] = t
    return [len(e.ids) for e in _LOADED[path].encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with text; sources in one spelling."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                code, texts = pd.factorize(b.text)  # copies are tokenised once a batch
                yield pd.DataFrame({"doc_id": b.doc_id, "source": b.source, "n_tokens": np.array(_count(list(texts), tokenizer))[code]})

    some = documents.where("text is not null and text <> ''").select("doc_id", united(F.col("source")).alias("source"), "text")
    return some.mapInPandas(run, "doc_id long, source string, n_tokens int").where("n_tokens > 0")


# --- fitting one source's budget ------------------------------------------------------------
def subset_sum(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many of each length to take so that the sum comes as near to ``goal`` as can be.

    A bounded knapsack on bit sets: each length enters in binary portions; bit s of the set
    tells that s can be reached. Lengths are added until the goal itself can be.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    if goal <= 0 or not len(lengths):
        return take
    room = goal + int(lengths.max())  # sums just above the goal may be nearer
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []  # steps: (index, copies, set before)
    for i in np.argsort(lengths, kind="stable"):
        left, size = min(int(counts[i]), room // int(lengths[i])), 1
        while left > 0 and not reach >> goal & 1:
            n = min(size, left)
            steps.append((int(i), n, reach))
            reach |= (reach << (n * int(lengths[i]))) & mask
            left, size = left - n, size * 2
        if reach >> goal & 1:
            break
    best = next(s for d in range(room + 1) for s in (goal - d, goal + d) if 0 <= s <= room and reach >> s & 1)
    for i, n, before in reversed(steps):
        if not before >> best & 1:
            take[i] += n
            best -= n * int(lengths[i])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, repeats: int) -> tuple[int, np.ndarray]:
    """(whole rounds, extra documents of each length) that come nearest to ``budget``."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if total == 0 or budget <= 0:
        return 0, np.zeros(len(lengths), np.int64)
    if budget >= total * repeats:
        return repeats, np.zeros(len(lengths), np.int64)
    rounds, rest = divmod(int(budget), total)
    extra = (counts * rest) // total  # in proportion, rounded down
    left = rest - int((lengths * extra).sum())
    # spend what rounding left but for a few documents' worth, largest first
    spare = counts - extra
    keep = 4 * int(np.median(np.repeat(lengths, np.minimum(counts, SMOOTH))))
    for i in np.argsort(-lengths, kind="stable"):
        n = min(int(spare[i]), max(0, left - keep) // int(lengths[i]))
        if n:
            extra[i] += n
            spare[i] -= n
            left -= n * int(lengths[i])
    extra += subset_sum(lengths, spare, left)
    return rounds, extra


# --- operators ------------------------------------------------------------------------------
def budgets(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, share, max_repeats, tokens, budget), one row a target; tables of targets are small."""
    have = counts.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long")).alias("tokens"))
    goal = targets.groupBy(united(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = goal.where("source is not null").join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    w = Window.partitionBy(F.lit(0))  # one row a target
    t = t.withColumn("share", F.when(usable, F.try_divide("target_share", F.sum(F.when(usable, F.col("target_share"))).over(w))).otherwise(0.0))
    most = F.min(F.when(usable, F.try_divide(F.col("tokens") * F.col("max_repeats"), F.col("share")))).over(w)
    most = F.least(most, F.lit(float(total_tokens))) if total_tokens is not None else most
    return t.withColumn("budget", F.coalesce(F.round(most * F.col("share")).cast("long"), F.lit(0)))


def plan(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, n_tokens, rounds, extra): how many documents of each length each source adds to its whole rounds."""
    hist = counts.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    both = hist.join(budgets(counts, targets, total_tokens).where("budget > 0").select("source", "budget", "max_repeats"), "source")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens", ignore_index=True)
        rounds, extra = fit_budget(pdf.n_tokens, pdf.n, int(pdf.budget.iat[0]), int(pdf.max_repeats.iat[0]))
        return pd.DataFrame({"source": pdf.source, "n_tokens": pdf.n_tokens, "rounds": rounds, "extra": extra})

    return both.groupBy("source").applyInPandas(run, "source string, n_tokens int, rounds int, extra long")


def select(counts: DataFrame, fitted: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mix and how often each is used."""
    keyed = counts.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int"))
    sizes = keyed.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    room = sizes.join(fitted, ["source", "n_tokens"]).withColumn("room", F.col("extra") - F.col("before"))
    room = room.select("source", "n_tokens", "bucket", "rounds", "room", F.when(F.col("room") <= 0, "none").when(F.col("room") >= F.col("c"), "all").otherwise("some").alias("kind"))
    docs = keyed.join(room, ["source", "n_tokens", "bucket"])
    whole = docs.where("kind <> 'some'").select("doc_id", "source", "n_tokens", (F.col("rounds") + (F.col("kind") == "all").cast("int")).alias("copies"))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "bucket").orderBy("h", "doc_id"))
    edge = docs.where("kind = 'some'").withColumn("r", rank)
    edge = edge.select("doc_id", "source", "n_tokens", (F.col("rounds") + (F.col("r") <= F.col("room")).cast("int")).alias("copies"))
    return whole.unionByName(edge).where("copies > 0")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, n_tokens, copies) and the shares really reached.

    Token counts are written to the shared checkpoint folder, so texts are tokenised once.
    """
    counts = cut(token_counts(documents, tokenizer))
    chosen = select(counts, plan(counts, targets, total_tokens), seed)
    used = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("tokens_used"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies")
    )
    goal = budgets(counts, targets, total_tokens)
    w = Window.partitionBy(F.lit(0))  # one row a target
    report = goal.join(used, "source", "left").select(
        "source", "target_share", F.col("share").alias("feasible_share"), "max_repeats", "budget",
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return chosen, report.withColumn("actual_share", F.coalesce(F.try_divide("tokens_used", F.sum("tokens_used").over(w)), F.lit(0.0)))


def mix_selection(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the mix."""
    return mix(documents, targets)[0]


def mix_shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Target, feasible and actual share of every source with a target."""
    return mix(documents, targets)[1]


def mix_balance(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, feasible_share, in_share, in_repeats): whether the selection, added up anew, keeps each target.

    ``in_share``: the selected tokens are at most one document (the longest selected) from the feasible share of all.
    """
    chosen, report = mix(documents, targets)
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("t"), F.max("copies").alias("c"), F.max("n_tokens").alias("longest"))
    all_used = used.agg(F.sum("t").alias("all"), F.max("longest").alias("most"))  # one row
    r = report.select("source", "target_share", "feasible_share", "max_repeats").join(used, "source", "left").join(F.broadcast(all_used))
    off = F.abs(F.coalesce("t", F.lit(0)) - F.col("feasible_share") * F.coalesce("all", F.lit(0)))
    return r.select("source", F.round("target_share", 9).alias("target_share"), F.round("feasible_share", 9).alias("feasible_share"), (off <= F.coalesce("most", F.lit(0))).alias("in_share"), (F.coalesce("c", F.lit(0)) <= F.col("max_repeats")).alias("in_repeats"))
