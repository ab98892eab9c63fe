"""Splits that keep related records together.

Method: grouped iterative stratification. Records that share a key (a recording, an author, an entity) form components;
label vectors are aggregated per component; components with the rarest outstanding label are placed first, each into
the split that needs that label most.

Distribution: components are found by joining and aggregating (one key) or by alternating large-star and small-star
steps with checkpoints (several keys). There is one round per label; in each, the BLOCK components with most of the
label are placed first, the others in range-sorted blocks, each of which fills its part of what is still needed, so no
task or driver ever holds all components. The steps are the same at every size.

Nulls and ties: a record without any key is a component of its own. Records without labels count by number only. Equal
needs go to the first split; equal components are ordered by a hash of their
key. Repeated label rows count as often as they occur. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.session import cut

SPLITS = ("train", "validation", "test")
RATIOS = (0.8, 0.1, 0.1)
LABELS = ("ivr", "human", "hold", "survey", "unknown")
#: Components that are placed one after another, by the driver or a task.
BLOCK = 10_000
#: What the open part of records counts beside that of the label.
SIZE_WEIGHT = 0.25

# Endings of a recording's name that a copy or an export adds.
COPY_ENDING = r"(?:\.(?:beeped|wav|mp3|mp4|m4a|flac|ogg|opus|aac)|\s*\(\d+\)|[\s_.-]+v\d+|[\s_.-]+(?:copy|export)(?:[\s_.-]*\d+)?)+$"


def recording_key(name: Column) -> Column:
    """What a recording's name or path names, without case, blanks, punctuation, file and copy endings; NULL if nothing is left."""
    base = F.regexp_replace(F.lower(F.trim(name)), r"^.*[/\\]", "")
    key = F.regexp_replace(F.regexp_replace(F.trim(base), COPY_ENDING, ""), r"[^\p{L}\p{N}]+", "")
    return F.when(key != "", key)


def split_name(tag: Column) -> Column:
    """The split a tag spells, NULL for none; an unknown tag is a split of its own."""
    t = F.regexp_replace(F.lower(tag), r"[^\p{L}\p{N}]+", "")
    known = F.when(t.rlike(r"^tr(ain|n)?(ing)?(set|split|data)?$"), "train").when(t.rlike(r"^(val|valid|validate|validation|dev|development)(set|split|data)?$"), "validation").when(t.rlike(r"^te?st(ing)?(set|split|data)?$"), "test")
    return F.when(t != "", F.coalesce(known, t))


def components(records: DataFrame, record: str, keys: Sequence[str], most_rounds: int = 50) -> DataFrame:
    """(record, component): records that share a value of any key, directly or over others, are one component.

    With one key the component is its value; with several, edges between records and key values are contracted by
    large-star and small-star steps until nothing changes.
    """
    own = F.concat(F.lit("r:"), F.col(record).cast("string"))
    if len(keys) == 1:
        return records.select(F.col(record), F.coalesce(F.concat(F.lit("k0:"), F.col(keys[0]).cast("string")), own).alias("component"))
    nodes = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"k{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)]
    edges = records.select(own.alias("u"), F.explode(F.array_compact(F.array(*nodes))).alias("v")).distinct()
    edges = cut(edges)
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    root = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return records.select(F.col(record), own.alias("node")).join(root, "node", "left").select(record, F.coalesce("component", "node").alias("component"))


def profiles(members: DataFrame, record: str, labelled: DataFrame, labelled_record: str, label: Column, tag: Column | None = None) -> DataFrame:
    """(component, records, labels array, tags): label counts and present splits per component; labelled rows are aggregated per record before they are joined."""
    known = F.lower(F.trim(label))
    counts = [F.count_if(known == x).alias(f"l{i}") for i, x in enumerate(LABELS)] + [F.count_if(known.isNotNull() & ~known.isin(*LABELS)).alias(f"l{len(LABELS)}")]
    tags = F.collect_set(split_name(tag)) if tag is not None else F.array().cast("array<string>")
    per_record = labelled.filter(F.col(labelled_record).isNotNull()).groupBy(F.col(labelled_record).alias(record)).agg(*counts, (tags if tag is not None else F.first(tags)).alias("tags"))
    names = [f"l{i}" for i in range(len(LABELS) + 1)]
    joined = members.join(per_record, record, "left")
    return joined.groupBy("component").agg(
        F.count(F.lit(1)).alias("records"),
        F.array(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).alias("labels"),
        F.array_distinct(F.flatten(F.collect_set("tags"))).alias("tags"),
    )


class Needs:
    """How many records of each label, and in all, each split still needs. Splits beyond those asked for (of a split that is kept) need nothing."""

    def __init__(self, labels: np.ndarray, size: np.ndarray):
        self.labels, self.size = labels, size
        self.all_labels, self.all_size = np.maximum(labels, 1e-9), np.maximum(size, 1e-9)

    @classmethod
    def of(cls, totals: np.ndarray, records: float, share: np.ndarray) -> Needs:
        return cls(share[:, None] * totals[None, :], share * records)

    def part(self, totals: np.ndarray, records: float, share: np.ndarray) -> Needs:
        """The needs of a block that holds so many records: its part of what is still needed, by the plain shares where nothing is needed any more."""
        left, size = np.maximum(self.labels, 0), np.maximum(self.size, 0)
        by_label = np.where(left.sum(0) > 0, left / np.maximum(left.sum(0), 1e-12), share[:, None])
        return Needs(by_label * totals, (size / size.sum() if size.sum() > 0 else share) * records)

    def place(self, counts: np.ndarray, size: np.ndarray, label: int | None) -> np.ndarray:
        """Split numbers of components in the order given. A component goes where the largest part of what was needed of its label is open, records counting a quarter as much, among the splits that need it whole; one that is too large for all goes where most is needed. Equal needs go to the first split. Needs change in place."""
        out = np.empty(len(size), np.int64)
        for i in range(len(size)):
            need, whole, take = (self.size, self.all_size, size[i]) if label is None else (self.labels[:, label], self.all_labels[:, label], counts[i, label])
            open_ = need / whole + SIZE_WEIGHT * self.size / self.all_size
            fits = need >= take
            out[i] = s = int(np.where(fits, open_, -np.inf).argmax() if fits.any() else need.argmax())
            self.labels[s] -= counts[i]
            self.size[s] -= size[i]
        return out


def label_order(by_mask: dict[int, np.ndarray]) -> list[int]:
    """Labels from the rarest outstanding one on, given the label totals of the components by the bits of the labels they hold: once a label is served, its components are placed and no longer outstanding."""
    order: list[int] = []
    while True:
        left = sum((t for mask, t in by_mask.items() if not any(mask >> k & 1 for k in order)), np.zeros(len(LABELS) + 1))
        open_ = [k for k in range(len(left)) if left[k] > 0]
        if not open_:
            return order
        order.append(min(open_, key=lambda k: left[k]))


def assign_splits(profile: DataFrame, ratios: Sequence[float] = RATIOS, splits: Sequence[str] = SPLITS, keep: bool = False) -> DataFrame:
    """(component, split) for every component of profiles().

    keep: a component whose tags name exactly one split stays there and only uses up that split's needs; the others are
    placed. The same steps at every size: one round per label, from the rarest outstanding one on, and a last one for what
    holds no label. In a round the BLOCK components with most of the label are placed one after another by the driver;
    the others follow in range-sorted blocks of about BLOCK, each by its part of what the round still needs. So a rare
    label is placed as a whole, and large components come before small ones.
    """
    width, names = len(LABELS) + 1, list(splits)
    share = np.array(ratios, float) / sum(ratios)
    mask = sum((F.when(F.col("labels")[k] > 0, 1 << k).otherwise(0) for k in range(width)), F.lit(0))
    kept = F.when(F.size("tags") == 1, F.col("tags")[0]) if keep else F.lit(None).cast("string")
    profile = cut(profile.select("component", "records", "labels", mask.alias("mask"), kept.alias("kept"), F.xxhash64("component").alias("h")))
    sums = [F.sum("records").alias("records"), F.count(F.lit(1)).alias("n"), *[F.sum(F.col("labels")[k]).alias(f"t{k}") for k in range(width)]]
    vector = lambda r: np.array([r[f"t{k}"] for k in range(width)], float)
    # at most 2 ** width masks, with the few names of splits
    cells = profile.groupBy("mask", F.when(F.col("kept").isin(*names), F.col("kept")).alias("kept"), F.col("kept").isNotNull().alias("stays")).agg(*sums).collect()
    needs = Needs.of(sum((vector(r) for r in cells), np.zeros(width)), float(sum(r["records"] for r in cells)), share)
    for r in cells:
        if r["stays"] and r["kept"] is not None:
            needs.labels[names.index(r["kept"])] -= vector(r)
            needs.size[names.index(r["kept"])] -= r["records"]
    asked = [r for r in cells if not r["stays"]]
    order = label_order({r["mask"]: vector(r) for r in asked})
    number = F.lit(len(order))
    for i, k in reversed(list(enumerate(order))):
        number = F.when(F.col("mask").bitwiseAND(1 << k) != 0, i).otherwise(number)
    weight = F.lit(0)
    for i, k in enumerate(order):
        weight = F.when(F.col("round") == i, F.col("labels")[k]).otherwise(weight)
    todo = profile.filter("kept IS NULL").withColumn("round", number).withColumn("weight", F.when(F.col("round") == len(order), F.col("records")).otherwise(weight))
    # at most BLOCK components of each of the few rounds reach the driver
    first = W.partitionBy("round").orderBy(F.desc("weight"), "h", "component")
    tops = todo.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= BLOCK).orderBy("round", "k").collect()
    size_of = lambda i: sum(r["n"] for r in asked if next((j for j, k in enumerate(order) if r["mask"] >> k & 1), len(order)) == i)
    done: list[tuple[str, str]] = []
    out = profile.filter("kept IS NOT NULL").select("component", F.col("kept").alias("split"))
    for i, label in enumerate([*order, None]):
        top = [r for r in tops if r["round"] == i]
        if top:
            got = needs.place(np.array([r["labels"] for r in top], float), np.array([r["records"] for r in top], float), label)
            done += [(r["component"], names[s]) for r, s in zip(top, got)]
        blocks = -(-(size_of(i) - len(top)) // BLOCK)
        if blocks > 0:
            last = top[-1]
            after = (F.col("weight") < last["weight"]) | ((F.col("weight") == last["weight"]) & ((F.col("h") > last["h"]) | ((F.col("h") == last["h"]) & (F.col("component") > last["component"]))))
            rest = cut(_in_blocks(todo.filter((F.col("round") == i) & after), blocks, needs, share, label, names))
            for r in rest.groupBy("split").agg(*sums).collect():
                needs.labels[names.index(r["split"])] -= vector(r)
                needs.size[names.index(r["split"])] -= r["records"]
            out = out.unionByName(rest.select("component", "split"))
    placed = profile.sparkSession.createDataFrame(done, "component string, split string")
    return out.unionByName(placed)


def _in_blocks(rest: DataFrame, blocks: int, needs: Needs, share: np.ndarray, label: int | None, names: list[str]) -> DataFrame:
    """Places the components in range-sorted blocks; a block is one task's and holds about BLOCK components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            block = pd.concat(parts)
            counts, size = np.array(block["labels"].tolist(), float), block["records"].to_numpy(float)
            got = needs.part(counts.sum(0), size.sum(), share).place(counts, size, label)
            yield block.assign(split=[names[s] for s in got])[["component", "records", "labels", "split"]]

    by = [F.desc("weight"), F.col("h"), F.col("component")]
    return rest.repartitionByRange(blocks, *by).sortWithinPartitions(*by).select("component", "records", "labels").mapInPandas(run, "component string, records bigint, labels array<bigint>, split string")


def recordings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source, file, audio): the recordings that a chunk's columns name."""
    return chunks.select("chunk_id", *[recording_key(F.col(c)).alias(n) for c, n in (("source_call", "source"), ("source_file", "file"), ("audio_path", "audio"))])


def recording_members(chunks: DataFrame) -> DataFrame:
    """(chunk_id, component): chunks by the recording that source_call, else source_file, names."""
    named = chunks.select("chunk_id", F.coalesce(recording_key(F.col("source_call")), recording_key(F.col("source_file"))).alias("recording"))
    return components(named, "chunk_id", ["recording"])


def recording_profiles(members: DataFrame, clips: DataFrame) -> DataFrame:
    return profiles(members, "chunk_id", clips, "call_id", F.coalesce("final_label", "label"), F.col("split_tag"))


def recording_splits(chunks: DataFrame, clips: DataFrame) -> DataFrame:
    """(chunk_id, recording, split): a split for every chunk, one split per recording."""
    members = recording_members(chunks)
    return members.join(assign_splits(recording_profiles(members, clips)), "component").select("chunk_id", F.col("component").alias("recording"), "split")


def leaking_chunks(chunks: DataFrame, clips: DataFrame) -> DataFrame:
    """p1_found: (chunk_id) of every chunk of a recording with a clip that now is in another split than its recording is placed in. Recordings with one split keep it, so these are the recordings whose clips carry two or more."""
    members = recording_members(chunks)
    profile = cut(recording_profiles(members, clips))
    moved = assign_splits(profile, keep=True).join(profile.select("component", "tags"), "component").filter(F.exists("tags", lambda t: t != F.col("split")))
    return members.join(moved, "component", "left_semi").select("chunk_id")
