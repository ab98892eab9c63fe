"""Consensus from several annotators' labels.

Method: community confusion model. Annotators belong to types; every type has a confusion matrix, and an annotator's own
matrix has a Dirichlet prior centred on the matrices of its type, so annotators with few labels lean on their type.
Item labels, annotator types and all matrices are inferred by variational updates.

A vote is seen as its class together with its bin of stated confidence, so a matrix also learns what an annotator's
doubt is worth; confidences on scales of 5, 10 or 100 are brought to 1 by the annotator's largest value.

The matrices of the types are updated by the fixed point of a Dirichlet-multinomial mean: an annotator with n votes of a
kind counts like the expected number of distinct draws, strength * m * (digamma(n + strength * m) - digamma(strength * m)),
which grows with the logarithm of n, so the busiest annotators do not speak for their type alone. No vote is left out.

Distribution: votes become one row per item (an item has at most one vote per annotator), written once; a round is one
pass over these rows that returns sums per (annotator, class, label). The annotators' matrices are sent to the tasks
while their size is within MOST_BROADCAST annotators; beyond that they stay a table and are joined to the votes. Start,
updates and stopping rule are the same functions in both, so the labels are the same.

Nulls and ties: a null label is an abstention; an annotator's last vote (time, then vote id) counts, so a last null vote
withdraws earlier ones. Votes without item or annotator are left out. An item without any vote gets the most frequent
class and agreement NULL. Equal posteriors take the first class in order. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.session import cut

CLASSES = ("ivr", "human", "hold", "survey", "unknown")
K = len(CLASSES)
#: Borders of the bins of stated confidence on a scale of 0 to 1; the last bin is for votes without one.
CONFIDENCE = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9)
BINS = len(CONFIDENCE) + 2
#: What is seen of a vote: its class and its bin of confidence.
V = K * BINS
#: Annotators whose matrices (K * V doubles each, 3 MB at most) may be sent to every task and summed on the driver.
MOST_BROADCAST = 2_000
#: What every class has of an item's first posterior besides its votes.
FIRST = 1e-3
#: Steps of the share of agreement by which types start.
STEPS = 200


@dataclass(frozen=True)
class CommunityConfig:
    communities: int = 6
    strength: float = 20.0
    diagonal: float = 4.0
    off: float = 0.5
    most_rounds: int = 40
    #: Parts by which the classes' expected numbers of items and the types' sums may still move in the last round.
    settled: float = 1e-4
    settled_types: float = 0.01


def class_name(label: Column) -> Column:
    """The class a label spells; NULL for null or unreadable labels."""
    t = F.regexp_replace(F.lower(label), r"[^\p{L}]+", "")
    return F.when(t.isin(*CLASSES), t).when(t == "onhold", "hold").when(t.isin("unk", "unkn"), "unknown")


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), 0.0
    for _ in range(6):
        out, x = out - 1 / x, x + 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def log_gamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), 0.0
    for _ in range(7):
        out, x = out - np.log(x), x + 1
    y = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y / 1260)) / x


def by_class(seen: np.ndarray) -> np.ndarray:
    """Sums over the bins of confidence: (..., K, V) to (..., K, K)."""
    return seen.reshape(*seen.shape[:-1], K, BINS).sum(-1)


def annotator_update(counts: np.ndarray, matrices: np.ndarray, weights: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For annotators with expected counts (n, K, V): expected log matrices, own mean confusion matrices (n, K, K), type responsibilities (n, C)."""
    prior = strength * matrices
    fit = np.stack([(log_gamma(p.sum(1)) - log_gamma(p.sum(1) + counts.sum(2))).sum(1) + (log_gamma(p + counts) - log_gamma(p)).sum((1, 2)) for p in prior], 1) + np.log(np.maximum(weights, 1e-12))
    resp = np.exp(fit - fit.max(1, keepdims=True))
    resp /= resp.sum(1, keepdims=True)
    beta = np.einsum("nc,ckl->nkl", resp, prior) + counts
    return digamma(beta) - digamma(beta.sum(2, keepdims=True)), by_class(beta / beta.sum(2, keepdims=True)), resp


def prior_means() -> np.ndarray:
    """A type's mean matrix before any vote (K, V)."""
    return community_means(np.zeros((1, K, V)), CommunityConfig())[0]


def community_update(counts: np.ndarray, resp: np.ndarray, matrices: np.ndarray, config: CommunityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Sums for the types' matrices (C, K, V) and weights (C) from annotators' expected counts (n, K, V)."""
    prior = config.strength * matrices
    sums = np.stack([(r[:, None, None] * p * (digamma(p + counts) - digamma(p))).sum(0) for r, p in zip(resp.T, prior)])
    return sums, resp.sum(0)


def first_types(counts: np.ndarray) -> np.ndarray:
    """How often annotators agree with the first posterior, in STEPS steps; types start as quantiles of it."""
    share = np.trace(by_class(counts), axis1=1, axis2=2) / np.maximum(counts.sum((1, 2)), 1e-9)
    return np.minimum((STEPS * share + 1e-9).astype(int), STEPS - 1)


def type_of_step(histogram: np.ndarray, config: CommunityConfig) -> np.ndarray:
    """The type that annotators of each step of agreement start in, from the numbers of annotators by step."""
    return np.minimum((np.r_[0, np.cumsum(histogram)[:-1]] * config.communities / max(1.0, histogram.sum())).astype(int), config.communities - 1)


def first_sums(counts: np.ndarray, kind: np.ndarray, config: CommunityConfig) -> np.ndarray:
    return community_update(counts, np.eye(config.communities)[kind[first_types(counts)]], np.repeat(prior_means()[None], config.communities, 0), config)[0]


def class_prior(mass: np.ndarray) -> np.ndarray:
    return np.log((mass + 1) / (mass + 1).sum())


def settled(mass: np.ndarray, before: np.ndarray, sums: np.ndarray, sums_before: np.ndarray, config: CommunityConfig) -> bool:
    """Whether neither the classes' expected numbers of items nor the types' sums moved by more than a small part."""
    moved = lambda a, b, part: np.abs(a - b).sum() <= part * max(1.0, np.abs(a).sum())
    return moved(mass, before, config.settled) and moved(sums, sums_before, config.settled_types)


def community_means(sums: np.ndarray, config: CommunityConfig) -> np.ndarray:
    m = sums + np.repeat(config.off + (config.diagonal - config.off) * np.eye(K), BINS, axis=1) / BINS
    return m / m.sum(2, keepdims=True)


def latest_votes(votes: DataFrame) -> DataFrame:
    """(item_id, labeler, vote): class number * BINS + bin of confidence of every annotator's last vote on an item; NULL for abstentions."""
    number = F.array_position(F.array(*map(F.lit, CLASSES)), class_name(F.col("label"))) - 1
    stated = F.col("confidence").cast("double") if "confidence" in votes.columns else F.lit(None).cast("double")
    conf = F.when(~F.isnan(stated) & (stated >= 0), stated)
    last = votes.filter("item_id IS NOT NULL AND labeler IS NOT NULL").groupBy("item_id", F.lower(F.trim("labeler")).alias("labeler")).agg(F.max_by(F.struct(number.alias("k"), conf.alias("c")), F.struct("voted_ts", "vote_id")).alias("v"))
    last = last.select("item_id", "labeler", "v.k", "v.c")
    top = F.max("c")
    scale = last.groupBy("labeler").agg(F.when(top > 10, 100.0).when(top > 5, 10.0).when(top > 1, 5.0).otherwise(1.0).alias("scale"))
    c = F.col("c") / F.col("scale")
    bin_ = F.when(F.col("c").isNull(), len(CONFIDENCE) + 1).otherwise(sum((c >= x).cast("int") for x in CONFIDENCE))
    return last.join(scale, "labeler").select("item_id", "labeler", (F.col("k") * BINS + bin_).cast("int").alias("vote"))


def _posterior(flat_item: np.ndarray, scores: np.ndarray, n: int, prior: np.ndarray) -> np.ndarray:
    logp = np.tile(prior, (n, 1))
    np.add.at(logp, flat_item, scores)
    p = np.exp(logp - logp.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _flatten(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = batch["who"].map(len).to_numpy()
    flat = lambda c: np.concatenate([np.asarray(x, np.int64) for x in batch[c]]) if len(batch) else np.array([], np.int64)
    return np.repeat(np.arange(len(batch)), sizes), flat("who"), flat("vote")


@dataclass
class Consensus:
    """items: item_id, label, posterior, agreement, n_votes; labelers: labeler, community, reliability, n_votes."""

    items: DataFrame
    labelers: DataFrame


def consensus(votes: DataFrame, config: CommunityConfig = CommunityConfig(), most_broadcast: int = MOST_BROADCAST) -> Consensus:
    """Infer item labels and annotators' reliability."""
    last = cut(latest_votes(votes))
    labelers = last.filter("vote IS NOT NULL").groupBy("labeler").agg(F.count(F.lit(1)).alias("n_votes"))
    names = [r["labeler"] for r in labelers.select("labeler").orderBy("labeler").limit(most_broadcast + 1).collect()]
    if len(names) <= most_broadcast:
        return _broadcast_rounds(last, names, config)
    return _joined_rounds(last, config)


def _start(last: DataFrame) -> DataFrame:
    """(item_id, q0..): first posterior of the items, their vote shares with a small share for every class."""
    n = [F.count_if(F.floor(F.col("vote") / BINS) == k) + FIRST for k in range(K)]
    return last.groupBy("item_id").agg(*[x.alias(f"q{k}") for k, x in enumerate(n)]).select("item_id", *[(F.col(f"q{k}") / sum(F.col(f"q{j}") for j in range(K))).alias(f"q{k}") for k in range(K)])


def _broadcast_rounds(last: DataFrame, names: list[str], config: CommunityConfig) -> Consensus:
    spark = last.sparkSession
    number = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "labeler string, who int")
    rows = last.join(number, "labeler", "left").groupBy("item_id").agg(F.collect_list(F.when(F.col("vote").isNotNull(), F.struct("who", "vote"))).alias("votes"))
    items = cut(rows.select("item_id", F.col("votes.who").alias("who"), F.col("votes.vote").alias("vote")))
    n = len(names)

    def counts_of(step) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, mass = np.zeros((n, K, V)), np.zeros(K)
            for batch in batches:
                item, who, vote = _flatten(batch)
                q = step(item, who, vote, len(batch))
                mass += q.sum(0)
                np.add.at(total.transpose(0, 2, 1), (who, vote), q[item])
            cells = np.flatnonzero(total)
            yield pd.DataFrame({"cell": np.r_[cells, -1 - np.arange(K)], "value": np.r_[total.ravel()[cells], mass]})

        got = items.mapInPandas(run, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        at, value = got["cell"].to_numpy(np.int64), got["value"].to_numpy(float)
        total, mass = np.zeros(n * K * V), np.zeros(K)
        total[at[at >= 0]], mass[-1 - at[at < 0]] = value[at >= 0], value[at < 0]
        total = total.reshape(n, K, V)
        return total, mass

    def first(item, who, vote, size):
        q = np.full((size, K), FIRST)
        np.add.at(q, (item, vote // BINS), 1.0)
        return q / q.sum(1, keepdims=True)

    counts, mass = counts_of(first)
    kind = type_of_step(np.bincount(first_types(counts), minlength=STEPS), config)
    sums = first_sums(counts, kind, config)
    matrices, weights = community_means(sums, config), np.full(config.communities, 1 / config.communities)
    for _ in range(config.most_rounds):
        log_matrix, _, resp = annotator_update(counts, matrices, weights, config.strength)
        before, sums_before = mass, sums
        sums, weight = community_update(counts, resp, matrices, config)
        matrices, weights = community_means(sums, config), (weight + 1) / (weight + 1).sum()
        shared = spark.sparkContext.broadcast((log_matrix, class_prior(mass)))

        def step(item, who, vote, size):
            m, p = shared.value
            return _posterior(item, m[who, :, vote], size, p)

        counts, mass = counts_of(step)
        if settled(mass, before, sums, sums_before, config):
            break
    prior = class_prior(mass)
    log_matrix, own, resp = annotator_update(counts, matrices, weights, config.strength)
    shared = spark.sparkContext.broadcast((log_matrix, prior))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, p = shared.value
        for batch in batches:
            item, who, vote = _flatten(batch)
            q = _posterior(item, m[who, :, vote], len(batch), p)
            best = q.argmax(1)
            votes_on = np.bincount(item, minlength=len(batch))
            with_best = np.bincount(item, weights=(vote // BINS == best[item]), minlength=len(batch))
            yield pd.DataFrame({"item_id": batch["item_id"], "label": [CLASSES[k] for k in best], "posterior": q.max(1), "agreement": [a / b if b else None for a, b in zip(with_best, votes_on)], "n_votes": votes_on})

    found = items.mapInPandas(finish, "item_id bigint, label string, posterior double, agreement double, n_votes bigint")
    mass = np.exp(prior)
    people = [(names[i], int(resp[i].argmax()), float((mass * np.diag(own[i])).sum()), int(round(counts[i].sum()))) for i in range(n)]
    return Consensus(found, spark.createDataFrame(people, "labeler string, community int, reliability double, n_votes bigint"))


def _joined_rounds(last: DataFrame, config: CommunityConfig) -> Consensus:
    """The same rounds with annotators as a table of their own: votes are joined to the annotators' matrices."""
    given = last.filter("vote IS NOT NULL")
    posterior = cut(_start(last))
    q_cols = [f"q{k}" for k in range(K)]

    def annotators(posterior: DataFrame) -> DataFrame:
        # one row per annotator: its expected counts by vote, at most V entries
        stats = given.join(posterior, "item_id").groupBy("labeler", "vote").agg(*[F.sum(c).alias(c) for c in q_cols])
        return cut(stats.groupBy("labeler").agg(F.collect_list(F.struct("vote", F.array(*q_cols).alias("q"))).alias("stats")))

    def counts_of(batch: pd.DataFrame) -> np.ndarray:
        c = np.zeros((len(batch), K, V))
        for i, rows in enumerate(batch["stats"]):
            for r in rows:
                c[i, :, r["vote"]] = r["q"]
        return c

    def summed(people: DataFrame, cells) -> np.ndarray:
        """Sums over the annotators of what cells(counts) gives, an array of fixed length."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v = cells(counts_of(b))
                    yield pd.DataFrame({"cell": np.arange(len(v)), "value": v})

        got = people.mapInPandas(run, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").toPandas()
        return got["value"].to_numpy(float)

    people = annotators(posterior)
    mass_of = lambda posterior: np.array(posterior.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in q_cols]).first(), float)
    mass = mass_of(posterior)
    histogram = summed(people, lambda c: np.bincount(first_types(c), minlength=STEPS).astype(float))
    kind = type_of_step(histogram if len(histogram) else np.zeros(STEPS), config)
    shape = (config.communities, K, V)
    sums = summed(people, lambda c: first_sums(c, kind, config).ravel())
    sums = sums.reshape(shape) if len(sums) else np.zeros(shape)
    matrices, weights = community_means(sums, config), np.full(config.communities, 1 / config.communities)
    out_schema = "labeler string, n_votes double, community int, reliability double, m array<double>"

    def updated(people: DataFrame, matrices, weights, prior) -> tuple[DataFrame, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                c = counts_of(b)
                m, own, resp = annotator_update(c, matrices, weights, config.strength)
                rel = np.einsum("nkk,k->n", own, np.exp(prior))
                yield pd.DataFrame({"labeler": b["labeler"], "n_votes": c.sum((1, 2)), "community": resp.argmax(1), "reliability": rel, "m": list(m.reshape(len(b), -1))})

        def cells(c: np.ndarray) -> np.ndarray:
            return np.concatenate([x.ravel() for x in community_update(c, annotator_update(c, matrices, weights, config.strength)[2], matrices, config)])

        return people.mapInPandas(run, out_schema), summed(people, cells)

    def scored(params: DataFrame, prior: np.ndarray) -> DataFrame:
        """Posteriors of all items from the annotators' matrices."""
        votes = given.join(params.select("labeler", "m"), "labeler").select("item_id", *[F.element_at("m", F.lit(k * V + 1) + F.col("vote")).alias(f"s{k}") for k in range(K)])
        logs = votes.groupBy("item_id").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(K)])
        full = last.select("item_id").distinct().join(logs, "item_id", "left").select("item_id", *[(F.coalesce(f"s{k}", F.lit(0.0)) + float(prior[k])).alias(f"s{k}") for k in range(K)])
        top = F.greatest(*[F.col(f"s{k}") for k in range(K)])
        raw = full.select("item_id", *[F.exp(F.col(f"s{k}") - top).alias(f"q{k}") for k in range(K)])
        return cut(raw.select("item_id", *[(F.col(c) / sum(F.col(x) for x in q_cols)).alias(c) for c in q_cols]))

    for _ in range(config.most_rounds):
        params, got = updated(people, matrices, weights, class_prior(mass))
        before, sums_before = mass, sums
        if len(got):
            sums, weight = got[: sums.size].reshape(shape), got[sums.size :]
            matrices, weights = community_means(sums, config), (weight + 1) / (weight + 1).sum()
        posterior = scored(params, class_prior(mass))
        people = annotators(posterior)
        mass = mass_of(posterior)
        if settled(mass, before, sums, sums_before, config):
            break
    params, _ = updated(people, matrices, weights, class_prior(mass))
    params = cut(params)
    posterior = scored(params, class_prior(mass))
    best = F.expr("CASE " + " ".join(f"WHEN q{k} = top THEN {k}" for k in range(K)) + " END")
    picked = posterior.withColumn("top", F.greatest(*q_cols)).select("item_id", best.alias("best"), F.col("top").alias("posterior"))
    counted = last.join(picked, "item_id").groupBy("item_id").agg(F.first("best").alias("best"), F.first("posterior").alias("posterior"), F.count("vote").alias("n_votes"), F.count_if(F.floor(F.col("vote") / BINS) == F.col("best")).alias("with_best"))
    items = counted.select("item_id", F.element_at(F.array(*map(F.lit, CLASSES)), F.col("best") + 1).alias("label"), "posterior", F.when(F.col("n_votes") > 0, F.col("with_best") / F.col("n_votes")).alias("agreement"), "n_votes")
    return Consensus(items, params.select("labeler", "community", "reliability", F.round("n_votes").cast("bigint").alias("n_votes")))
