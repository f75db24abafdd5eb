"""Messages made of stuffed keywords, link lists or product tags.

Weak labels come from who writes to whom, not from what is written: an address whose mail others answer, or that writes often, is a
correspondent; one that wrote once or twice, from a host nobody ever answered, is a stranger. Most strangers' mail is unwanted, not all,
and correspondents send some unwanted mail too. What unwanted mail looks like is learned from content and link features, which the
labels know nothing of: the words of ordinary prose from the document frequencies of all labelled messages, then bagged decision
trees from a bounded sample of them. The trees score every message, whoever sent it, and the scores are smoothed with the rate of the
sender's host, so that a doubtful message takes after the host's others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, sized_broadcast, spread
from .mail import END, LINK, own_lines

#: Weakly labelled messages the trees are trained on at most (about; drawn by a hash of the id).
TRAINING_ROWS = 20_000
TREES, DEPTH, LEAST_LEAF, TRIED_FEATURES, BINS = 25, 6, 5, 6, 32
#: Each tree draws at least this share of its rows from either label, so that the rarer one's kinds show.
LEAST_SHARE = 1 / 3
#: Weight of the host's rate in a message's log odds, and the messages' worth of the overall rate that a host starts with.
HOST_WEIGHT, HOST_PRIOR = 0.3, 5.0
#: Weak labels: messages (repeated ones once) from which an address writes often, and up to which it is a stranger's.
OFTEN, ONCE = 10, 2
#: Words of prose: in this share of the correspondents' messages, and this many times as frequent there as in strangers'.
PROSE_SHARE, PROSE_RATIO = 0.01, 2.0
#: A sentence has at least this many words and this share of words of prose.
SENTENCE_WORDS, SENTENCE_SHARE = 4, 0.3
#: Words a task counts before it passes its counts on; only memory depends on it.
WORDS_HELD = 500_000

_URL = re.compile(r"<?(?:https?://|www\.)\S+")
_MARKDOWN = re.compile(r"\[([^\]\n]*)\]\((?:https?://|www\.)[^)\s]*\)?")
_ANCHOR = re.compile(f"{LINK}([^{END}]*){END}?")
_DATA_LINE = re.compile(r"\d{1,2}:\d\d|.*\t|[^\W\d_]+ \d+:|\d{4}-\d\d-\d\d")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_STOP = re.compile(r"(?<=[.!?])\s+")
_SEPARATOR = re.compile(r"[,;|/•#]")

FEATURES = ("sentences", "data", "links", "loose", "log_words", "log_links", "prose_words", "distinct_words", "top_word", "distinct_pairs", "often_repeated", "digits", "separators", "hashes", "capitals", "per_line", "stops", "longest_sentence", "link_lines")
WORDS = FEATURES.index("log_words")


def distinct_words(own: str) -> set[str]:
    """Lower-case words outside links of a message's own lines."""
    if LINK in own or "://" in own or "www." in own:
        own = _URL.sub(" ", _ANCHOR.sub(" ", _MARKDOWN.sub(" ", own)))
    return set(map(str.lower, _WORD.findall(own)))


def features(own: str, prose: frozenset[str]) -> list[float]:
    """Values of ``FEATURES`` of own lines; shares refer to the own words, of which a link's address is one."""
    sentence = data = loose = links = link_words = longest = link_lines = 0
    words: list[str] = []
    lower: list[str] = []
    paragraphs, held, lines = [], [], 0
    for line in [*own.split("\n"), ""]:
        if line and not _DATA_LINE.match(line):
            held.append(line)
            lines += 1
            if (LINK in line or "://" in line or "www." in line) and len(_WORD.findall(_URL.sub("", _ANCHOR.sub("", _MARKDOWN.sub("", line))))) < SENTENCE_WORDS:
                link_lines += 1
            continue
        if held:
            paragraphs.append(" ".join(held))
            held = []
        if line:
            data += len(_WORD.findall(line))
            lines += 1

    def as_link(m: re.Match) -> str:
        nonlocal links, link_words
        links += 1
        link_words += 1 + (len(_WORD.findall(m.group(1))) if m.re is not _URL else 0)
        return " "

    body = []
    for p in paragraphs:
        if LINK in p or "://" in p or "www." in p:
            p = _URL.sub(as_link, _ANCHOR.sub(as_link, _MARKDOWN.sub(as_link, p)))
        body.append(p)
        for s in _STOP.split(p):
            w = _WORD.findall(s)
            low = [x.lower() for x in w]
            if len(w) >= SENTENCE_WORDS and sum(map(prose.__contains__, low)) >= SENTENCE_SHARE * len(w):
                sentence += len(w)
            else:
                loose += len(w)
            longest = max(longest, len(w))
            words += w
            lower += low
    total = max(sentence + data + loose + link_words, 1)
    n, seen = max(len(lower), 1), Counter(lower)
    joined = "\n".join(body)
    return [
        sentence / total, data / total, link_words / total, loose / total, math.log1p(sentence + data + loose + link_words), math.log1p(links),
        sum(map(prose.__contains__, lower)) / n, len(seen) / n, max(seen.values(), default=0) / n, len(set(zip(lower, lower[1:]))) / n,
        sum(c for w, c in seen.items() if c >= 4 and w not in prose) / n, len(_DIGIT.findall(joined)) / max(len(joined), 1), len(_SEPARATOR.findall(joined)) / n,
        joined.count("#") / n, sum(w[0].isupper() for w in words) / n, n / max(lines, 1), sum(map(joined.count, ".!?")) / n, math.log1p(longest), link_lines / max(lines, 1),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1 in a leaf), threshold, children, value; all trees padded to one length."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = self.feature[t, at]
                go_left = x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[t, at]
                at = np.where(f < 0, at, np.where(go_left, self.left[t, at], self.right[t, at]))
            total += self.value[t, at]
        return total / len(self.feature)


def _grow(codes: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator) -> list[tuple]:
    nodes: list[list] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        mean = float(y[rows].mean())
        nodes.append([-1, 0.0, at, at, mean])
        if depth == DEPTH or len(rows) < 2 * LEAST_LEAF or mean in (0.0, 1.0):
            return at
        best = (1e-9, None, None)
        for f in rng.choice(codes.shape[1], min(TRIED_FEATURES, codes.shape[1]), replace=False):
            c = codes[rows, f]
            n = np.bincount(c, minlength=BINS).cumsum()[:-1].astype(float)
            pos = np.bincount(c, weights=y[rows], minlength=BINS).cumsum()[:-1]
            m, q = len(rows) - n, y[rows].sum() - pos
            fits = (n >= LEAST_LEAF) & (m >= LEAST_LEAF)
            if fits.any():
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(fits, pos * pos / n + q * q / m, -1.0) - len(rows) * mean * mean
                k = int(gain.argmax())
                if gain[k] > best[0] and k < len(cuts[f]):
                    best = (gain[k], f, k)
        if best[1] is None:
            return at
        _, f, k = best
        low = codes[rows, f] <= k
        nodes[at][0], nodes[at][1] = int(f), float(cuts[f][k])
        nodes[at][2] = build(rows[low], depth + 1)
        nodes[at][3] = build(rows[~low], depth + 1)
        return at

    build(np.arange(len(y)), 0)
    return [tuple(n) for n in nodes]


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Forest:
    """Bagged trees: each on rows drawn with replacement, each split among a few features tried. Without rows every score is 0."""
    if not len(y):
        x, y = np.zeros((1, len(FEATURES))), np.zeros(1)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    trees = []
    labels = [np.flatnonzero(y == k) for k in (0, 1)]
    share = min(max(len(labels[1]) / len(y), LEAST_SHARE), 1 - LEAST_SHARE)
    for _ in range(TREES):
        if all(map(len, labels)):
            ones = round(len(y) * share)
            rows = np.r_[rng.choice(labels[1], ones), rng.choice(labels[0], len(y) - ones)]
        else:
            rows = rng.integers(0, len(y), len(y))
        trees.append(_grow(codes[rows], y[rows].astype(float), cuts, rng))
    size = max(map(len, trees))
    arrays = [np.array([[n[i] for n in t] + [-1 if i == 0 else 0] * (size - len(t)) for t in trees]) for i in range(5)]
    return Forest(arrays[0].astype(np.int64), arrays[1].astype(float), arrays[2].astype(np.int64), arrays[3].astype(np.int64), arrays[4].astype(float))


def train_on_weak_labels(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Forest:
    """Trees of either half of the rows judge the other half's; correspondents' messages that look like strangers' are left out of the trees that count.

    Strangers' messages all stay: those that look like correspondents' are few among many and change little, while a kind of which there
    are a handful would be judged by trees that hardly saw it.
    """
    if len(y):
        half = np.random.default_rng(seed).random(len(y)) < 0.5
        judged = np.zeros(len(y))
        for h in (half, ~half):
            judged[~h] = train(x[h], y[h], seed).score(x[~h])
        kept = (judged <= 0.5) | (y == 1)
        x, y = x[kept], y[kept]
    return train(x, y, seed)


def _own_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = ["\n".join(own_lines(t)) if t else "" for t in batch.column("text").to_pylist()]
        keep = ["doc_id", "address", "host", "message_id", "in_reply_to"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(own, pa.string())], names=[*keep, "own"])


def own_texts(docs: DataFrame) -> DataFrame:
    """doc_id, address and host (of from_addr, or null), message_id, in_reply_to and the own lines of every message, each parsed once."""
    address = F.nullif(F.lower(F.regexp_extract("from_addr", r"([^\s<>@]+@[^@>\s]+)>?\s*$", 1)), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), address.alias("address"), F.substring_index(address, "@", -1).alias("host"), "message_id", "in_reply_to", "text")
    return spread(rows).mapInArrow(_own_task, "doc_id BIGINT, address STRING, host STRING, message_id STRING, in_reply_to STRING, own STRING")


def address_labels(messages: DataFrame) -> DataFrame:
    """(address, label) of the addresses about which the conversations leave little doubt: 0 for correspondents, 1 for strangers.

    A reply counts only from another address. Replies are reduced to the smallest and largest address for each message they answer, and
    messages to counts for each address, before anything is joined, so neither a message that thousands answer nor an address that a third
    of all messages come from meets a single task.
    """
    mails = messages.select("address", "host", F.coalesce("message_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("message_id")).where("address IS NOT NULL")
    replies = messages.where("in_reply_to IS NOT NULL AND address IS NOT NULL").groupBy(F.col("in_reply_to").alias("message_id")).agg(F.min("address").alias("first"), F.max("address").alias("last"))
    answered = mails.join(replies, "message_id").where("first != address OR last != address").groupBy("address").agg(F.count(F.lit(1)).alias("n_answered"))
    per = mails.groupBy("address", "host").agg(F.count_distinct("message_id").alias("n")).join(answered, "address", "left").withColumn("n_answered", F.coalesce("n_answered", F.lit(0)))
    per = materialize(per, "addresses")
    hosts = per.groupBy("host").agg(F.sum("n_answered").alias("host_answered"))
    known = per.join(sized_broadcast(hosts), "host")
    label = F.when((F.col("n_answered") > 0) | (F.col("n") >= OFTEN), 0).when((F.col("n") <= ONCE) & (F.col("host_answered") == 0), 1)
    return known.select("address", label.alias("label")).where("label IS NOT NULL")


def _word_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def passed_on() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in counts]], names=["word", "n0", "n1"])

    for batch in batches:
        for own, label in zip(batch.column("own").to_pylist(), batch.column("label").to_pylist(), strict=True):
            if words := distinct_words(own):
                counts[label].update(words)
                counts[label][""] += 1  # the messages themselves
        if len(counts[0]) + len(counts[1]) > WORDS_HELD:
            yield passed_on()
            for c in counts:
                c.clear()
    yield passed_on()


def prose_words(labelled: DataFrame) -> frozenset[str]:
    """Words of prose, from the document frequencies of all labelled messages (own, label): at most ``1 / PROSE_SHARE`` times the mean number of distinct words of a message come to the driver."""
    counts = labelled.where("label IS NOT NULL").select("own", "label").mapInArrow(_word_task, "word STRING, n0 BIGINT, n1 BIGINT").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = materialize(counts, "document-frequencies")
    total = counts.where("word = ''").first()
    if total is None or not total["n0"]:
        return frozenset()
    n0, n1 = total["n0"], total["n1"]
    often = counts.where((F.col("word") != "") & (F.col("n0") >= PROSE_SHARE * n0) & (F.col("n0") / n0 >= PROSE_RATIO * (F.col("n1") + 1) / (n1 + 2)))
    return frozenset(r["word"] for r in often.select("word").collect())


def _feature_task(prose: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(own, prose) for own in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), pa.array(x, pa.list_(pa.float64())), batch.column("label")], names=["doc_id", "host", "x", "label"])

    return run


def message_features(docs: DataFrame) -> DataFrame:
    """doc_id, host, x (features) and label (1, 0 or null, of the sender) of every message."""
    messages = materialize(own_texts(docs), "own-texts")
    labels = materialize(address_labels(messages), "address-labels")
    labelled = messages.join(sized_broadcast(labels), "address", "left").select("doc_id", "host", "own", "label")
    return labelled.mapInArrow(_feature_task(prose_words(labelled)), "doc_id BIGINT, host STRING, x ARRAY<DOUBLE>, label INT")


def training_sample(measured: DataFrame, bound: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """About ``bound`` labelled messages at most, half of either label as far as there are so many, drawn evenly by a hash of the id."""
    sizes = {r["label"]: r["n"] for r in measured.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two numbers
    keep = [F.when(F.col("label") == k, F.lit(int(2**40 * min(1.0, bound / 2 / n)))) for k, n in sizes.items()]
    if not keep:
        return np.zeros((0, len(FEATURES))), np.zeros(0, dtype=np.int64)
    drawn = measured.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2**40)) < F.coalesce(*keep)))
    rows = drawn.select("doc_id", "x", "label").orderBy("doc_id", "x").limit(2 * bound).collect()
    return np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows], dtype=np.int64)


def _score_task(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), pa.array(forest.score(x) * (x[:, WORDS] > 0))], names=["doc_id", "host", "score"])

    return run


def score_messages(docs: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, host, score (of the trees), host_rate, smoothed (the final score) of every message, once per input row.

    A message without own words, or null or empty, has score 0 and smoothed 0; short ones are scored as all others, their
    length being one of the features. Messages without sender are scored, but neither labelled nor smoothed. Without any stranger's
    message nothing is learned and every score is 0. ``host_rate`` is the mean score of the host's other messages and of
    ``HOST_PRIOR`` average ones. Only doc_id, message_id, in_reply_to, from_addr and text are read; any of them may be null.
    """
    measured = materialize(message_features(docs), "message-features")
    forest = train_on_weak_labels(*training_sample(measured, bound))
    return smooth_by_host(materialize(measured.select("doc_id", "host", "x").mapInArrow(_score_task(forest), "doc_id BIGINT, host STRING, score DOUBLE"), "scores"))


def smooth_by_host(scored: DataFrame) -> DataFrame:
    """Adds ``host_rate`` and ``smoothed`` to (doc_id, host, score), see :func:`score_messages`. A score of 0 stays: there is nothing to doubt."""
    overall = scored.agg(F.avg("score")).first()[0] or 0.0
    hosts = materialize(scored.where("host IS NOT NULL").groupBy("host").agg(F.sum("score").alias("host_sum"), F.count(F.lit(1)).alias("host_n")), "host-rates")
    joined = scored.join(sized_broadcast(hosts), "host", "left")
    rate = (F.col("host_sum") - F.col("score") + HOST_PRIOR * overall) / (F.col("host_n") - 1 + HOST_PRIOR)

    def log_odds(c):
        c = F.least(F.greatest(c, F.lit(0.005)), F.lit(0.995))
        return F.log(c / (1 - c))

    moved = log_odds(F.col("score")) + F.when(F.col("host").isNull(), 0.0).otherwise(HOST_WEIGHT * (log_odds(rate) - log_odds(F.lit(overall))))
    smoothed = F.when(F.col("score") == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-moved)))
    return joined.select("doc_id", "host", "score", rate.alias("host_rate"), smoothed.alias("smoothed"))


def spam_messages(docs: DataFrame, cut: float = 0.5, bound: int = TRAINING_ROWS) -> DataFrame:
    """Distinct ids of the messages whose smoothed score is above ``cut``."""
    return score_messages(docs, bound).where(F.col("smoothed") > cut).select("doc_id").distinct()
