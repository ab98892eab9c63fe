"""Splits and consensus labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import annotators, splits


def test_recording_key(spark):
    names = ["abcd1234-7", " ABCD1234-7", "abcd1234_7", "Abcd1234 - 7", "abcd1234-7_v2", "abcd1234-7 (1)", "/srv/x/abcd1234-7 (1).beeped.wav", "abcd1234-7.wav", "abcd1234-8", None, "", " - "]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in names], "n string").select(splits.recording_key(F.col("n"))).collect()]
    assert got[:8] == ["abcd12347"] * 8 and got[8] == "abcd12348" and got[9:] == [None] * 3


def test_split_names(spark):
    tags = ["Train ", "trn", "training", "VAL", "valid", "dev", "Validation", "tst", "TEST", "other", None, " "]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in tags], "n string").select(splits.split_name(F.col("n"))).collect()]
    assert got == ["train"] * 3 + ["validation"] * 4 + ["test"] * 2 + ["other", None, None]


def union_find(records):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, *keys in records:
        find(("r", i))
        for k, v in enumerate(keys):
            if v is not None:
                parent[find(("r", i))] = find((k, v))
    groups = {}
    for i, *_ in records:
        groups.setdefault(find(("r", i)), set()).add(i)
    return {frozenset(g) for g in groups.values()}


def test_components_of_several_keys(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, *range(60)]), r.choice([None, "hot", *map(str, range(90))])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, author int, source string").withColumn("component", F.lit("clash"))
    got = splits.components(df, "id", ["author", "source"]).collect()
    groups = {}
    for x in got:
        groups.setdefault(x["component"], set()).add(x["id"])
    assert {frozenset(g) for g in groups.values()} == union_find(rows)


def chunk_rows(n, hot=0):
    r = random.Random(1)
    chunks = [(f"c{i}", f"rec{'hot' if i < hot else i // r.randint(1, 6)}-1", None) for i in range(n)]
    clips = [(f"c{r.randrange(n)}", r.choice(splits.LABELS), None, r.choice(["train", "TEST", None])) for _ in range(2 * n)]
    return chunks, clips


def frames(spark, chunks, clips):
    return spark.createDataFrame(chunks, "chunk_id string, source_call string, source_file string").withColumn("audio_path", F.lit(None).cast("string")), spark.createDataFrame(clips, "call_id string, label string, final_label string, split_tag string").withColumn("labels", F.lit(1))


def test_splits_hold_groups_and_shares(spark):
    c, k = frames(spark, *chunk_rows(3000))
    got = splits.recording_splits(c, k).toPandas()
    assert len(got) == 3000 and got["chunk_id"].is_unique
    assert (got.groupby("recording")["split"].nunique() == 1).all()
    share = got["split"].value_counts() / len(got)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02 and abs(share["validation"] - 0.1) < 0.02
    labels = k.toPandas().merge(got, left_on="call_id", right_on="chunk_id")
    for _, g in labels.groupby("label"):
        assert abs((g["split"] == "train").mean() - 0.8) < 0.04


def test_splits_with_a_third_in_one_recording(spark):
    c, k = frames(spark, *chunk_rows(3000, hot=1000))
    got = splits.recording_splits(c, k).toPandas()
    assert (got.groupby("recording")["split"].nunique() == 1).all()
    assert abs((got["split"] == "train").mean() - 0.8) < 0.03


def test_splits_of_empty_tables(spark):
    c, k = frames(spark, *chunk_rows(10))
    assert splits.recording_splits(c.limit(0), k).count() == 0
    assert splits.recording_splits(c, k.limit(0)).count() == 10
    assert splits.leaking_chunks(c, k.limit(0)).count() == 0


def made_votes(n_items=400, seed=0):
    r = np.random.default_rng(seed)
    skill = {f"a{i:02d}": s for i, s in enumerate([0.95, 0.9, 0.85, 0.8, 0.6, 0.55, 0.5, 0.3, 0.3])}
    truth, rows = [], []
    for i in range(n_items):
        t = int(r.integers(0, 5))
        truth.append(annotators.CLASSES[t])
        for w in r.choice(sorted(skill), size=int(r.integers(2, 7)), replace=False):
            right = r.random() < skill[w]
            v = t if right else int(r.integers(0, 5))
            rows.append((len(rows), i, str(w), annotators.CLASSES[v].upper() + " " * int(r.integers(0, 2)), len(rows)))
    return rows, truth


def votes_frame(spark, rows):
    return spark.createDataFrame(rows, "vote_id long, item_id long, labeler string, label string, voted_ts long").withColumn("who", F.lit("clash"))


def test_consensus_beats_majority_and_both_ways_agree(spark):
    rows, truth = made_votes()
    v = votes_frame(spark, rows)
    a = annotators.consensus(v)
    got = {r["item_id"]: r for r in a.items.collect()}
    right = np.mean([got[i]["label"] == t for i, t in enumerate(truth)])
    majority = {}
    for _, i, _, lab, _ in rows:
        majority.setdefault(i, []).append(lab.strip().lower())
    plain = np.mean([max(sorted(set(majority[i])), key=majority[i].count) == t for i, t in enumerate(truth)])
    assert right >= plain
    rel = {r["labeler"]: r["reliability"] for r in a.labelers.collect()}
    assert rel["a00"] > rel["a04"] > rel["a08"] - 0.05
    b = annotators.consensus(v, most_broadcast=3)
    other = {r["item_id"]: r for r in b.items.collect()}
    assert {i: r["label"] for i, r in other.items()} == {i: r["label"] for i, r in got.items()}
    assert all(abs(other[i][c] - got[i][c]) < 1e-6 for i in got for c in ("posterior", "agreement"))
    same = {r["labeler"]: r for r in b.labelers.collect()}
    assert len(same) == 9 and all(abs(same[w]["reliability"] - x) < 1e-6 for w, x in rel.items())
    # agreement is the share of the item's votes that the label got; reliability follows the share of right votes, drawn to that of the type
    share = {i: np.mean([x.strip().lower() == got[i]["label"] for x in ls]) for i, ls in majority.items()}
    assert all(abs(got[i]["agreement"] - x) < 1e-9 for i, x in share.items())
    right_votes = {w: np.mean([lab.strip().lower() == truth[i] for _, i, x, lab, _ in rows if x == w]) for w in rel}
    assert np.corrcoef([rel[w] for w in sorted(rel)], [right_votes[w] for w in sorted(rel)])[0, 1] > 0.97


def test_consensus_edge_cases(spark):
    rows = [(1, 1, "x", "ivr", 5), (2, 1, "x", None, 9), (3, 1, "y", "Hold", 1), (4, 2, "x", None, 1), (5, None, "x", "ivr", 1), (6, 3, None, "ivr", 1), (7, 4, "y", "on hold", 1), (8, 4, "y", "on hold", 1), (9, 4, "z", "??", 1)]
    got = {r["item_id"]: r for r in annotators.consensus(votes_frame(spark, rows)).items.collect()}
    assert sorted(got) == [1, 2, 4]
    assert got[1]["label"] == "hold" and got[1]["n_votes"] == 1  # the later null vote withdrew 'ivr'
    assert got[2]["n_votes"] == 0 and got[2]["agreement"] is None
    assert got[4]["label"] == "hold" and got[4]["n_votes"] == 1
    assert annotators.consensus(votes_frame(spark, rows).limit(0)).items.count() == 0


def test_special_functions():
    assert np.allclose(annotators.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890])
    assert np.allclose(annotators.log_gamma(np.array([1.0, 5.0, 0.5])), [0.0, np.log(24), 0.5 * np.log(np.pi)])


@pytest.mark.parametrize("block", [100, 400, 5_000])
def test_rare_label_reaches_every_split_in_any_number_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(splits, "BLOCK", block)
    rows = [(f"k{i:05d}", 1 + i % 3, [1 + i % 2, 0, 0, 0, int(i % 60 == 0), 0], []) for i in range(3000)]
    got = splits.assign_splits(spark.createDataFrame(rows, PROFILE)).toPandas()
    assert len(got) == 3000 and got["component"].is_unique
    number = got["component"].str[1:].astype(int)
    rare = got[number % 60 == 0]["split"].value_counts().to_dict()
    assert abs(rare["train"] - 40) <= 2 and abs(rare["validation"] - 5) <= 2 and abs(rare["test"] - 5) <= 2
    for weight in (1 + number % 3, 1 + number % 2):  # records and the common label
        share = weight.groupby(got["split"]).sum() / weight.sum()
        assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02


PROFILE = "component string, records long, labels array<long>, tags array<string>"


def test_kept_splits(spark):
    """A component with one tag stays, one with several is placed, one without is placed; an unknown tag is a split of its own."""
    rows = [("a", 5, [1, 0, 0, 0, 0, 0], ["test"]), ("b", 1, [1, 0, 0, 0, 0, 0], ["test", "train"]), ("c", 1, [0] * 6, []), ("d", 1, [0] * 6, ["gold"])]
    got = {r["component"]: r["split"] for r in splits.assign_splits(spark.createDataFrame(rows, PROFILE), keep=True).collect()}
    assert got["a"] == "test" and got["d"] == "gold" and got["b"] == "train" and set(got) == set("abcd")


def test_label_order():
    one = lambda **n: np.array([n.get(f"l{k}", 0) for k in range(len(splits.LABELS) + 1)], float)
    # label 2 is rarest; its components hold most of label 1, of which then less is outstanding than of label 0
    assert splits.label_order({0b110: one(l1=50, l2=5), 0b011: one(l0=9, l1=8), 0b001: one(l0=1), 0: one()}) == [2, 1, 0]
