"""Problem 9: filling fixed-capacity containers with items.

Conflict-constrained best fit, copies before other items and largest first: open containers are kept by what is left in
them, with bitmaps of the duplicate clusters and sources they hold. The search starts at the least residual that takes the
item and goes on to the next until the tightest compatible container is found; without one a container is opened. Only
items beyond the capacity are cut: full pieces fill containers of their own, the rest is an item like others.

What conflicts: two copies of one text, and two documents of one source. Where there are more of them than containers they
can't all be apart, so they are dealt out into shares that can: of a text one copy for each container the bucket needs at
least, of a source a part of that, less where no container more is needed for it (SPREAD). Documents of one share never meet, so no container holds more of a text or a
source than it has shares. ``conflicts`` reports what had to meet.

Items are dealt to buckets by the hash of their key, so copies and sources are dealt evenly, and each bucket is packed on
its own. A bucket holds some millions of tokens, thousands of containers, so what its last containers leave is small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.tokens import BYTE_BPE, TOKENIZERS, spread, token_count
from evispark.session import Scratch

BUCKET_TOKENS = 6_000_000
#: A container holds at most so many times a source's even part (and one document). Small documents fill what large ones
#: leave, so the even part itself would leave a tenth unused (sf0.1, 8192 tokens); from 16 on it is under 0.1 %.
SPREAD = 32
#: Half of it, and half again, is taken as long as a bucket needs no container more.
MOST_SPECS = 100


def _bits(values: np.ndarray, size: int) -> list[int]:
    """A bit for each share of at most ``size`` items of one value, dealt out in their order, so that all shares have large
    and small ones; 0 for missing values and lone items."""
    codes = pd.factorize(values)[0]
    counts = np.bincount(codes[codes >= 0]) if (codes >= 0).any() else np.zeros(0, dtype=int)
    shares = -(-counts // max(1, size))
    share = pd.Series(codes).groupby(codes).cumcount().to_numpy() % np.maximum(1, shares[codes] if len(shares) else 1)
    index: dict[tuple[int, int], int] = {}
    return [0 if c < 0 or counts[c] < 2 else 1 << index.setdefault((c, k), len(index)) for c, k in zip(codes.tolist(), share.tolist())]


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int) -> list[int]:
    """Container of each item, numbered from 0; like items come together; none beyond the capacity.

    clusters, sources: one bit each (0: none); items that share one never share a container. Items of size 0 conflict with
    nothing."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: containers with r left
    held, from_source, out = [], [], []
    last, spot = None, (0, 0)
    for size, cluster, source in zip(sizes, clusters, sources):
        bad, of = (cluster, source) if size else (0, 0)
        # What held off the like item before holds this one off too.
        residual, start = spot if last == (size, cluster, source) and bad | of else (size, 0)
        last, found = (size, cluster, source), -1
        while True:
            rest = mask >> residual
            if not rest:
                break
            step = (rest & -rest).bit_length() - 1
            if step:
                residual, start = residual + step, 0
            bins = open_at[residual]
            for at in range(start, len(bins)):
                b = bins[at]
                if not (held[b] & bad or from_source[b] & of):
                    found = at
                    break
            if found >= 0:
                break
            residual, start = residual + 1, 0
        if found >= 0:
            bins = open_at[residual]
            b = bins.pop(found)
            spot = (residual, found)
            if not bins:
                mask &= ~(1 << residual)
        else:
            b, residual = len(held), capacity
            held.append(0)
            from_source.append(0)
            spot = (capacity + 1, 0)
        held[b] |= bad
        from_source[b] |= of
        left = residual - size
        open_at[left].append(b)
        mask |= 1 << left
        out.append(b)
    return out


def _tightest(sizes: list[int], copies: list[int], source: np.ndarray, fewest: int, capacity: int) -> list[int]:
    """best_fit with the sources as far apart as needs no container more than SPREAD does."""
    spread, bits = SPREAD, _bits(source, fewest // SPREAD)
    best = best_fit(sizes, copies, bits, capacity)
    while spread > 1 and any(bits):
        spread //= 2
        bits = _bits(source, fewest // spread)
        closer = best_fit(sizes, copies, bits, capacity)
        if max(closer, default=-1) > max(best, default=-1):
            break
        best = closer
    return best


def pack_bucket(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """(doc_id, piece, first_token, n_tokens, container) of the items (doc_id, n, cluster, source) of one bucket."""
    n = pdf["n"].to_numpy(dtype="int64")
    full = np.maximum(0, -(-n // capacity) - 1)  # pieces before the last
    owner = np.repeat(np.arange(len(n)), full)
    cut_piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    rest = n - full * capacity
    fewest = int(-(-rest.sum() // capacity))
    ids, cluster, source = pdf["doc_id"].to_numpy(), pd.factorize(pdf["cluster"])[0], pd.factorize(pdf["source"])[0]
    # Copies first: late ones would open containers that little is left to fill.
    alone = np.bincount(cluster[cluster >= 0], minlength=1)[cluster] < 2
    order = np.lexsort((ids, source, cluster, -rest, alone))
    some = order[rest[order] > 0]
    placed = np.zeros(len(n), dtype="int64")  # what has no tokens stands in the first container
    placed[some] = _tightest(rest[some].tolist(), _bits(cluster[some], fewest), source[some], fewest, capacity)
    used = int(placed.max(initial=-1)) + 1
    return pd.DataFrame(
        {
            "doc_id": np.r_[ids, ids[owner]],
            "piece": np.r_[full, cut_piece].astype("int32"),
            "first_token": np.r_[full * capacity, cut_piece * capacity],
            "n_tokens": np.r_[rest, np.full(len(owner), capacity)].astype("int32"),
            "container": np.r_[placed, used + np.arange(len(owner))],
        }
    )


def pack_documents(
    documents: DataFrame, specs: DataFrame, scratch: Scratch, folder: str = TOKENIZERS, name: str = BYTE_BPE
) -> DataFrame:
    """(spec_id, capacity_tokens, container_id, doc_id, piece, first_token, n_tokens): every document once in full for each
    capacity, longer ones in pieces.

    Null and empty texts have 0 tokens and stand in some container. doc_id is unique. Capacities that are null or under 1
    are ignored. An empty table of documents or capacities gives an empty result. Extra columns are ignored."""
    wanted = specs.where("capacity_tokens >= 1").select("spec_id", "capacity_tokens").limit(MOST_SPECS + 1).collect()
    if len(wanted) > MOST_SPECS:
        raise ValueError(f"over {MOST_SPECS} capacities")
    sized = scratch.keep(
        spread(documents.select("doc_id", "text", "source")).select(
            "doc_id", token_count(F.col("text"), folder, name).alias("n"), F.xxhash64("text").alias("cluster"), "source"
        )
    )
    total = sized.agg(F.sum("n")).first()[0] or 0
    buckets = total // BUCKET_TOKENS + 1
    each = F.explode(
        F.array(*(F.struct(F.lit(int(r.spec_id)).cast("bigint").alias("spec_id"), F.lit(int(r.capacity_tokens)).cast("bigint").alias("capacity_tokens")) for r in wanted))
        if wanted else F.array().cast("array<struct<spec_id:bigint,capacity_tokens:bigint>>")
    )
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).select("*", each.alias("s")).select("*", "s.*").drop("s")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        spec, capacity, bucket = (int(pdf[c].iloc[0]) for c in ("spec_id", "capacity_tokens", "bucket"))
        out = pack_bucket(pdf, capacity)
        out["spec_id"], out["capacity_tokens"] = spec, capacity
        out["container_id"] = f"{spec}-{bucket}-" + out["container"].astype(str)
        return out[["spec_id", "capacity_tokens", "container_id", "doc_id", "piece", "first_token", "n_tokens"]]

    return dealt.groupBy("spec_id", "bucket").applyInPandas(
        pack, "spec_id bigint, capacity_tokens bigint, container_id string, doc_id bigint, piece int, first_token bigint, n_tokens int"
    )


def unused_space(packed: DataFrame) -> DataFrame:
    """Containers, tokens and unused share for each capacity."""
    per = packed.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"))
    return per.groupBy("spec_id", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"),
        (1 - F.sum("used") / (F.count("*") * F.first("capacity_tokens"))).alias("unused_share"),
    )


def conflicts(packed: DataFrame, documents: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, what, n_meetings, most) for "text" and "source": how many documents share a container with
    an earlier one of the same text or source, and how many of one stand in one container at most.

    Documents without tokens or source meet nothing; a longer document meets by its last piece only."""
    last = Window.partitionBy("spec_id", "doc_id").orderBy(F.desc("piece"))
    ends = packed.where("n_tokens > 0").withColumn("_k", F.row_number().over(last)).where("_k = 1")
    what = F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.xxhash64(n).alias("of"), F.col(n).isNotNull().alias("given")) for n in ("text", "source"))))
    named = documents.select("doc_id", what.alias("x")).select("doc_id", "x.*").where("given").drop("given")
    met = ends.join(named, "doc_id").groupBy("spec_id", "capacity_tokens", "container_id", "what", "of").agg(F.count("*").alias("n"))
    return met.groupBy("spec_id", "capacity_tokens", "what").agg(F.sum(F.col("n") - 1).alias("n_meetings"), F.max("n").alias("most"))
