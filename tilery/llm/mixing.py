"""Mixing sources to target weights, with soft membership.

A document whose declared source is one of the targets belongs to that domain. The others belong to the domains
softly: a classifier, multinomial naive Bayes on tokens fitted on labelled documents, gives each a posterior over the
domains. Nonnegative document rates, at most the domain's cap, are then fitted so that the expected domain totals
in tokens match the targets: least squares by projected gradient. Declared documents of one domain share their rate,
so of them one total a domain is enough; soft documents stay distributed, and a round exchanges one number per domain.
The step is scaled by the tokens of each document and the capacity of each domain, a majoriser of the curvature,
so the error falls in every round. Rounds go on until the totals settle.

The texts are read and tokenised once: the token counts, and the tokens of those documents the classifier needs
(the sample it is fitted on, and the soft ones), go to a checkpoint.

Defined cases: null and empty texts have no tokens; sources are compared in lower case without outer blanks; a
null, blank or unlisted source is soft (or left out, with soft=False); targets of one source are one, of their summed
weight and greatest cap, and those without a source or a positive weight or cap ask for nothing; a target without documents
reaches 0; repeated documents count each; no documents at all: every target reaches 0; other columns are kept, but for those
named rate or copies.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilery.plans.session import durable

#: Ranks of a public tokenizer; never copied here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of a text before merging that belongs to these ranks.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Labelled documents on which the classifier is fitted, at most about so many; its features, tokens modulo BUCKETS.
TRAIN_ROWS, BUCKETS = 50_000, 8192
#: A posterior counts at most so many tokens of evidence, since tokens of one text are no independent draws: the number of
#: these that predicts held-out labelled documents best, 0 (the prior alone) included; one in HELD_OUT is held out.
EVIDENCE, HELD_OUT = (0, 1, 3, 10, 30, 100, 300, 1000), 5
#: More targets than this are refused: target vectors are held by the driver and every task.
MAX_TARGETS = 1000
#: The fit ends when a round changes no total by more than this share of its target, or of the mean one; one that takes more rounds raises an error.
ROUNDS, TOLERANCE = 500, 1e-4


TOKENS = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.ShortType()))])


def tokenised(spark, vocabulary: str = VOCABULARY):
    """A Column function of a text and a flag: struct (tokens, ids), the number of tokens, and where the flag is set
    the tokens themselves modulo BUCKETS. The vocabulary file is sent to the executors once."""
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    kind = pa.list_(pa.int16())

    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import tiktoken

        pairs = (line.split() for line in ranks.value.splitlines() if line)
        merges = {base64.b64decode(a): int(b) for a, b in pairs}
        own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})
        for texts, wanted in batches:
            sizes, lists = [], []
            for text, keep in zip(texts.to_pylist(), wanted.to_pylist()):
                ids = own.encode_ordinary(text) if text else []
                sizes.append(len(ids))
                lists.append((np.array(ids, np.int64) % BUCKETS).astype(np.int16) if keep else None)
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(lists, kind)], ["tokens", "ids"])

    return F.arrow_udf(encode, TOKENS)


def source_form(source: Column | str) -> Column:
    return F.lower(F.trim(F.col(source) if isinstance(source, str) else source))


@dataclass
class Classifier:
    """Log probabilities of the tokens of each domain, log priors, and how many tokens of evidence count; with the documents it
    was tried on, the share it placed right, and its log loss there beside that of the prior."""

    words: np.ndarray
    priors: np.ndarray
    evidence: int = 30
    tried: int = 0
    accuracy: float | None = None
    loss: float | None = None
    prior_loss: float | None = None

    def logits(self, ids: np.ndarray, evidence: int) -> np.ndarray:
        logit = self.priors + (self.words[:, ids].mean(axis=1) * min(len(ids), evidence) if len(ids) else 0)
        logit = logit - logit.max()
        return logit - np.log(np.exp(logit).sum())

    def posterior(self):
        """A Column function: lists of tokens to posteriors over the domains; null for null."""
        model = self

        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for lists in batches:
                yield pd.Series([None if x is None else np.exp(model.logits(x, model.evidence)) for x in lists], dtype=object)

        return F.pandas_udf(score, T.ArrayType(T.DoubleType()))

    def try_on(self, documents: DataFrame, label: str, ids: str) -> None:
        """Chooses the evidence by labelled documents the model wasn't fitted on."""
        model = self

        def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, len(EVIDENCE)))
            for batch in batches:
                for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for at, n in enumerate(EVIDENCE):
                        logit = model.logits(np.array(x, np.int64), n)
                        sums[:, at] += 1, logit.argmax() == d, -logit[d]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(EVIDENCE))), *map(pa.array, sums)], names=["at", "n", "right", "loss"])

        rows = documents.select(label, ids).mapInArrow(losses, "at bigint, n double, right double, loss double").groupBy("at").agg(F.sum("n"), F.sum("right"), F.sum("loss"))
        found = {at: values for at, *values in rows.collect()}
        if found and found[0][0]:
            best = min(found, key=lambda at: (found[at][2], at))
            n, right, loss = found[best]
            self.evidence, self.tried, self.accuracy, self.loss, self.prior_loss = EVIDENCE[best], int(n), right / n, loss / n, found[0][2] / n


def sample_share(labelled: int, rows: int = TRAIN_ROWS) -> float:
    """The share of the labelled documents that the classifier is fitted on."""
    return min(1.0, rows / labelled) if labelled else 0.0


def fit_classifier(documents: DataFrame, label: str, ids: str, domains: int) -> Classifier:
    """Fits on documents with an integer label and a list of tokens modulo BUCKETS; rows without either don't count.

    It is tried on those held out, by a hash of their tokens so that copies stay together, and then fitted on all. What
    comes to the driver is one count per domain and bucket, at any size of the table."""
    held_out = F.pmod(F.xxhash64(ids), F.lit(HELD_OUT)) == 0
    known = documents.where(F.col(label).isNotNull() & F.col(ids).isNotNull()).select(F.col(label).alias("label"), F.col(ids).alias("ids"), held_out.alias("out"))
    counts = known.select("out", "label", F.explode("ids").alias("bucket")).groupBy("out", "label", "bucket").agg(F.count("*"))
    words, priors = np.zeros((2, domains, BUCKETS)), np.zeros((2, domains))
    for out, d, b, c in counts.collect():
        words[int(out), d, b] += c
    for out, d, c in known.groupBy("out", "label").agg(F.count("*")).collect():
        priors[int(out), d] += c
    fit = lambda w, p: Classifier(np.log((w + 1) / (w + 1).sum(axis=1, keepdims=True)), np.log((p + 1) / (p + 1).sum()))
    trial, model = fit(words[0], priors[0]), fit(words.sum(axis=0), priors.sum(axis=0))
    trial.try_on(known.where("out"), "label", "ids")
    trial.words, trial.priors = model.words, model.priors
    return trial


@dataclass
class Mix:
    """report: (source, weight, max_repeats, available, target, expected, short, rounds), one row a target.
    sizes: (source, tokens, rate, copies) of every document, from the checkpoint; the source is null if it isn't listed.
    documents: the documents with their rate and the whole number of copies drawn from it; of soft ones only the texts are
    tokenised again.
    classifier: what soft members were predicted with, and how well that went on held-out documents."""

    report: DataFrame
    sizes: DataFrame
    documents: DataFrame
    classifier: Classifier | None


def _rates(p: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates after the given steps, a pure function of the membership: rounds need no stored state."""
    most = p @ caps
    rate = np.minimum(1.0, most)
    for step in steps:
        rate = np.clip(rate - p @ step, 0.0, most)
    return rate


def _targets(targets: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, weights that sum to 1, and caps of the targets."""
    wanted = targets.select(source_form("source").alias("source"), "weight", "max_repeats").where("source <> ''")
    wanted = wanted.groupBy("source").agg(F.sum("weight"), F.max("max_repeats")).orderBy("source").limit(MAX_TARGETS + 1).collect()
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    weights = np.array([max(r[1] or 0.0, 0.0) for r in wanted], dtype=float)
    caps = np.array([max(r[2] or 0, 0) for r in wanted], dtype=float)
    return [r[0] for r in wanted], weights / weights.sum() if weights.sum() else weights, caps


def _soft_totals(soft: DataFrame, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Expected tokens that the soft documents (tokens, posterior) give each domain after the steps, and at rate 1."""
    size = len(caps)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size))
        for batch in batches:
            tokens = np.asarray(batch.column("tokens")).astype(float)
            p = np.asarray(batch.column("posterior").flatten()).reshape(len(tokens), size)
            sums += np.stack([(_rates(p, caps, steps) * tokens) @ p, tokens @ p])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), *(pa.array(x) for x in sums)], names=["d", "now", "capacity"])

    rows = soft.select("tokens", "posterior").mapInArrow(add, "d bigint, now double, capacity double").groupBy("d").agg(F.sum("now"), F.sum("capacity"))
    out = np.zeros((2, size))
    for d, *values in rows.collect():
        out[:, d] = values
    return out


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    key: str,
    text: str,
    source: str,
    soft: bool = True,
    rounds: int = ROUNDS,
    rows: int = TRAIN_ROWS,
    vocabulary: str = VOCABULARY,
) -> Mix:
    """Rates for the documents so that each source of `targets` (source, weight, max_repeats) gets its share of a
    mix as large as all documents with a listed source.

    The classifier is fitted on a hash sample of about `rows` labelled documents, drawn by key and text, so copies of one
    text are drawn one by one."""
    spark = documents.sparkSession
    names, weights, caps = _targets(targets)
    size = len(names)
    # a lookup of at most MAX_TARGETS entries
    places = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)]) if size else F.lit(None)
    label = (F.try_element_at(places, source_form(source)) if size else F.lit(None)).cast("int")
    # the result's own columns take the place of any of their names
    labelled = documents.drop(*({"rate", "copies"} - {key, text, source})).withColumn("__label", label)
    chance, encode = F.pmod(F.xxhash64(key, text), F.lit(1 << 40)) / float(1 << 40), tokenised(spark, vocabulary)
    if soft:
        # counted without reading the texts
        share = sample_share(labelled.where(F.col("__label").isNotNull()).count(), rows)
        sampled = F.pmod(F.xxhash64(F.lit("sample"), key, text), F.lit(1 << 20)) < int(share * (1 << 20))
        wanted = F.col("__label").isNull() | sampled
    else:
        labelled, wanted = labelled.where(F.col("__label").isNotNull()), F.lit(False)
    scanned = labelled.select(F.when(F.col("__label").isNotNull(), source_form(source)).alias("source"), F.col("__label").alias("label"), chance.alias("chance"), encode(F.col(text), wanted).alias("t"))
    scanned = durable(scanned.select("source", "label", "chance", "t.tokens", "t.ids"))
    declared = np.zeros(size)
    for d, n in scanned.where("label IS NOT NULL").groupBy("label").agg(F.sum("tokens")).collect():
        declared[d] = n
    members = model = None
    if soft and size:
        model = fit_classifier(scanned, "label", "ids", size)
        posterior = model.posterior()
        members = durable(scanned.where("label IS NULL").select("tokens", posterior("ids").alias("posterior")))

    whole = np.eye(size)
    softly = lambda steps: _soft_totals(members, caps, steps) if members is not None else np.zeros((2, size))
    steps: list[np.ndarray] = []
    others, capacity = softly(steps)
    goal, capacity = weights * declared.sum(), capacity + declared
    # no less than a part of the goal, lest a domain that documents hardly belong to outweigh all others
    scale = np.maximum(np.maximum(capacity, goal / 20), 1e-9)
    now, near = _rates(whole, caps, steps) * declared + others, TOLERANCE * np.maximum(goal, goal.mean() if size else 0)
    while True:
        if len(steps) == rounds:
            raise RuntimeError(f"the rates did not settle in {rounds} rounds: totals still change by up to {change.max():.0f} tokens")
        steps.append((now - goal) / scale)
        before, now = now, _rates(whole, caps, steps) * declared + softly(steps)[0]
        change = np.abs(now - before)
        if (change <= near).all():
            break
    short = now < goal * (1 - 10 * TOLERANCE)
    report = spark.createDataFrame(
        [
            (names[d], float(weights[d]), int(caps[d]), float(declared[d]), float(goal[d]), float(now[d]), bool(short[d]), len(steps))
            for d in range(size)
        ],
        "source string, weight double, max_repeats int, available double, target double, expected double, short boolean, rounds int",
    )
    of_domain = [float(x) for x in _rates(whole, caps, steps)]

    @F.arrow_udf(T.DoubleType())
    def soft_rate(posteriors: pa.Array) -> pa.Array:
        filled = posteriors.drop_null()
        p = np.asarray(filled.flatten()).reshape(len(filled), size)
        out = np.zeros(len(posteriors))
        out[np.asarray(posteriors.is_valid())] = _rates(p, caps, steps)
        return pa.array(out)

    def rated(frame: DataFrame, label: str, ids: Column | None, chance: Column) -> DataFrame:
        """The frame with rates and copies: those of declared documents are a lookup, only soft ones go to Python."""
        rate = F.get(F.array(*map(F.lit, of_domain)), F.col(label)) if size else F.lit(0.0)
        if members is not None:
            rate = F.when(F.col(label).isNull(), soft_rate(posterior(F.when(F.col(label).isNull(), ids)))).otherwise(rate)
        # a fraction of a copy is drawn by a hash of the key and text: the same at every run
        frame = frame.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        return frame.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))

    sizes = rated(scanned, "label", F.col("ids"), F.col("chance")).select("source", "tokens", "rate", "copies")
    again = encode(F.when(F.col("__label").isNull(), F.col(text)), F.col("__label").isNull())["ids"]
    return Mix(report, sizes, rated(labelled, "__label", again, chance).drop("__label"), model)


def reached_shares(mix: Mix) -> DataFrame:
    """(source, weight, target, expected, reached, reached_share): tokens of the copies drawn, by declared source.

    What comes from unlisted sources stands in a row of its own with a null weight."""
    drawn = durable(mix.sizes.groupBy(F.col("source").alias("drawn")).agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens")))
    whole = drawn.agg(F.sum("tokens")).first()[0]
    joined = mix.report.join(drawn, mix.report["source"] == drawn["drawn"], "full")
    reached = F.coalesce("tokens", F.lit(0))
    share = F.try_divide(reached, F.lit(whole)).cast("double").alias("reached_share")
    return joined.select("source", "weight", "target", "expected", reached.alias("reached"), share)
