import base64
import quopri
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.llm import mail, spam

HEAD = "From: A B <a.b@lab.test>\nSubject: x\n"
PROSE = "The night shift compared the calibration curve, and the result was 12 instead of 14. Please note that we asked about the soil cores before lunch. "
STUFFED = "cheap lamps best lamps lamps near tyres lamps cheap tyres " * 12
LINKS = "\n".join(f"http://www.shop{i}.test/lamps?ref={i}" for i in range(30))


def own(text):
    return " ".join(" ".join(mail.own_lines(text)).replace(mail.LINK, " ").replace(mail.END, " ").split())


def test_own_words():
    assert own(HEAD + "\nHello\n> quoted\n>> more\nbye\n-- \nA B\ntel. 1") == "Hello bye"
    assert own(HEAD.replace("\n", "\r\n") + "\r\nHello\r\n") == "Hello"
    assert own("no headers here") == "no headers here"
    packed = base64.encodebytes("Grüße an alle".encode()).decode()
    assert own(HEAD + "Content-Transfer-Encoding: base64\n\n" + packed) == "Grüße an alle"
    assert own(HEAD + "Content-Transfer-Encoding: base64\n\n" + packed[:10]).startswith("Grü")  # clipped
    assert own(HEAD + "Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring("schöne Grüße".encode()).decode()) == "schöne Grüße"
    multi = HEAD + 'MIME-Version: 1.0\nContent-Type: multipart/mixed;\n boundary="b1"\n\n--b1\nContent-Type: text/plain\n\nHello\n--b1\nContent-Type: application/pdf\nContent-Transfer-Encoding: base64\n\nQUJD\n'
    assert own(multi + "--b1--\n") == own(multi) == "Hello"  # with and without its end
    both = HEAD + 'Content-Type: multipart/alternative; boundary="b"\n\n--b\nContent-Type: text/plain\n\nHello\n--b\nContent-Type: text/html\n\n<p>Hello <a href="http://x.test">you</a></p><blockquote>no</blockquote><p>&gt; no</p>\n--b--'
    assert own(both) == "Hello you"
    assert own(HEAD + "\nHi\n________________\nThis is confidential.") == "Hi"
    assert own(HEAD + "\nHi\n-- \nA\n---------- Forwarded message ----------\nFrom: c\nDate: d\n\nnews") == "Hi news"
    assert own("") == own("From: a@b.c") == ""


NOUNS = "lamps tyres tea boots gloves visa tickets chairs perfume watches labels carpets".split()
OFFERS = "cheap buy best online wholesale discount premium bulk near free".split()
WHO = ["the night shift", "a reader", "our partner", "the crew", "someone from the office", "the review panel", "my neighbour"]
DID = ["compared", "has lost", "could not find", "ordered", "asked for", "did not open", "wrote about"]
WHAT = ["the calibration curve", "the soil cores", "an invoice for the enzymes", "the cold room keys", "the cheap lamps", "the tickets", "a box of gloves"]
THEN = ["before lunch", "because of the power cut", "with the help of a friend", "while the bay was closed", "as we agreed on Monday", "and nobody had noted why"]


def sentences(r, n):
    return " ".join(f"{r.choice(WHO).capitalize()} {r.choice(DID)} {r.choice(WHAT)} {r.choice(THEN)}." for _ in range(n))


def spam_body(r):
    """Made as the problem says, without a look at features: stuffed keywords, link lists, product tags; some with a sentence before."""
    kind = r.randrange(4)
    if kind == 0:
        own = r.sample(OFFERS, 4) + r.sample(NOUNS, 3)
        return " ".join(r.choice(own) for _ in range(r.randrange(40, 200)))
    if kind == 1:
        return "\n".join(f"{r.choice(['', r.choice(NOUNS) + ' '])}http://www.{r.choice('abcde')}-shop.test/{r.choice(NOUNS)}?ref={r.randrange(9999)}" for _ in range(r.randrange(8, 40)))
    if kind == 2:
        return " / ".join(f"{r.choice(['#', ''])}{r.choice(OFFERS)} {r.choice(NOUNS)} {r.randrange(90)} cm" for _ in range(r.randrange(12, 50)))
    return sentences(r, 1) + "\n\n" + ", ".join(f"{r.choice(OFFERS)} {r.choice(NOUNS)}" for _ in range(r.randrange(30, 80)))


def ham_body(r):
    kind = r.randrange(6)
    if kind == 0:
        return "\n".join(f"10:{i:02}:00 INFO lane {r.randrange(9)} tile {r.randrange(99)} pump retry" for i in range(r.randrange(5, 50)))
    if kind == 1:
        return sentences(r, 2) + "\n\n" + "\n".join(f"soil-{r.randrange(999)}\tBcgI\t{i}\t1.5%" for i in range(r.randrange(5, 40)))
    if kind == 2:
        return sentences(r, 1) + "\n\n" + "\n\n".join(f"http://docs.lab.test/page/{r.randrange(99)}\n{sentences(r, 1)}" for _ in range(r.randrange(2, 9)))
    if kind == 3:
        return r.choice(["ok", "Thanks a lot", "Best,\nA B", "See you there."])
    return sentences(r, r.randrange(1, 9)) + ("\n> " + spam_body(r).replace("\n", "\n> ") if kind == 4 else "")


def mailbox(seed, n_ham, n_spam, spam_in=0.2, ham_out=0.03):
    """Messages and truth. Correspondents answer each other; a fifth of the spam comes from them, and some proper mail from strangers."""
    r = random.Random(seed)
    rows, truth, ids = [], {}, []
    people = [f"p{i}@{h}.test" for i in range(25) for h in ("lab", "field", "desk")]
    for i in range(n_ham + n_spam):
        bad = i >= n_ham
        stranger = r.random() < (1 - spam_in if bad else ham_out)
        sender = f"x{i}@host{r.randrange(4 * n_spam)}.invalid" if stranger else r.choice(people)
        reply = r.choice(ids) if ids and not bad and not stranger and r.random() < 0.5 else None
        rows.append((i, HEAD + "\n" + (spam_body(r) if bad else ham_body(r)), f"Some One <{sender}>", f"<m{i}>", reply))
        truth[i] = bad
        if not bad and not stranger:
            ids.append(f"<m{i}>")
    r.shuffle(rows)
    return rows, truth


MAILS = "doc_id BIGINT, text STRING, from_addr STRING, message_id STRING, in_reply_to STRING"


def test_generated_mailbox(spark):
    """The truth is the generator's, the labels are the senders': a fifth of the spam is labelled as correspondents' mail, and is found all the same."""
    rows, truth = mailbox(1, 2400, 300)
    df = spark.createDataFrame(rows, MAILS).repartition(6)
    found = {r["doc_id"] for r in spam.spam_messages(df).collect()}
    cases = {i for i, bad in truth.items() if bad}
    assert len(found & cases) >= 0.95 * len(cases) and len(found & cases) >= 0.95 * len(found)
    inside = {row[0] for row in rows if row[0] in cases and "invalid" not in row[2]}
    assert len(inside) > 40 and len(found & inside) >= 0.9 * len(inside)
    labels = {r["address"]: r["label"] for r in spam.address_labels(spam.own_texts(df)).collect()}
    of_cases = [labels.get(row[2].split("<")[1][:-1]) for row in rows if row[0] in cases]
    assert 0.1 < of_cases.count(0) / len(of_cases) < 0.3  # so far are the labels from the truth


def test_held_out_messages_of_another_mailbox():
    """Trees and words learned on one mailbox judge another one."""
    def table(seed, prose=None):
        rows, truth = mailbox(seed, 1500, 250)
        own = ["\n".join(mail.own_lines(r[1])) for r in rows]
        sent = np.array([0 if ".test" in r[2] else 1 for r in rows])
        if prose is None:
            words = [Counter(w for o, s in zip(own, sent, strict=True) if s == k for w in spam.distinct_words(o)) for k in (0, 1)]
            n = [max((sent == k).sum(), 1) for k in (0, 1)]
            prose = frozenset(w for w, c in words[0].items() if c >= 0.01 * n[0] and c / n[0] >= 2 * (words[1][w] + 1) / (n[1] + 2))
        return np.array([spam.features(o, prose) for o in own]), sent, np.array([truth[r[0]] for r in rows]), prose

    x, sent, _, prose = table(2)
    forest = spam.train_on_weak_labels(x, sent)
    x, _, truth, _ = table(3, prose)
    got = forest.score(x) > 0.5
    assert (got & truth).sum() >= 0.95 * truth.sum() and (got & truth).sum() >= 0.95 * got.sum()


def test_labels_come_from_conversations_alone(spark):
    mails = [(1, "a@x.test", "<1>", None), (2, "b@y.test", "<2>", "<1>"), (3, "c@z.test", "<3>", None), (4, "d@x.test", "<4>", None), (5, "e@w.test", "<5>", "<5>"), (6, None, "<6>", "<3>"), (7, "f@w.test", None, None), (8, "f@w.test", None, None), (8, "f@w.test", None, None), (9, "g@v.test", None, "<nowhere>")]
    mails += [(100 + i, "bot@bot.test", f"<b{i}>", None) for i in range(10)] + [(200 + i, "h@q.test", f"<h{i}>", None) for i in range(3)]
    df = spark.createDataFrame([(i, "text", a, m, r) for i, a, m, r in mails], MAILS).withColumn("label", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("own", F.lit(1))
    got = {r["address"]: r["label"] for r in spam.address_labels(spam.own_texts(df)).collect()}
    # a is answered and d of the same host once heard; e answers itself; f wrote twice, h three times; nobody knows who answered c.
    assert got == {"a@x.test": 0, "b@y.test": 1, "c@z.test": 1, "e@w.test": 1, "f@w.test": 1, "g@v.test": 1, "bot@bot.test": 0}


def test_prose_words_are_learned(spark):
    rows, _ = mailbox(4, 600, 80)
    m = spam.own_texts(spark.createDataFrame(rows, MAILS).repartition(4))
    prose = spam.prose_words(m.join(spam.address_labels(m), "address", "left"))
    assert {"because", "lunch", "power", "nobody"} <= prose and not {"cheap", "wholesale", "tyres", "perfume"} & prose


def test_host_smoothing_moves_decisions(spark):
    """Two messages of the same score: one of a host whose other mail is spam, one of a host whose mail is proper."""
    rows = [(1000 + i, "good", 0.01) for i in range(200)] + [(500 + i, "bad", 0.95) for i in range(12)] + [(1, "bad", 0.45), (2, "good", 0.55), (3, None, 0.45), (4, None, 0.55), (5, "new", 0.45), (6, "bad", 0.0)]
    got = {r["doc_id"]: r for r in spam.smooth_by_host(spark.createDataFrame(rows, "doc_id BIGINT, host STRING, score DOUBLE")).collect()}
    assert got[1]["smoothed"] > 0.5 > got[2]["smoothed"] and got[3]["smoothed"] < 0.5 < got[4]["smoothed"] and got[5]["smoothed"] < 0.5 and got[6]["smoothed"] == 0.0
    assert abs(got[3]["smoothed"] - 0.45) < 1e-9


def test_forest_learns_what_no_single_split_shows():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(spam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    f = spam.train(x[:3000], y[:3000])
    assert ((f.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.8
    assert spam.train(np.zeros((0, len(spam.FEATURES))), np.zeros(0)).score(x[:2]).tolist() == [0.0, 0.0]


def test_odd_messages(spark):
    rows, truth = mailbox(5, 500, 80)
    n = len(rows)
    rows += [(n, None, None, None, None), (n + 1, "", "a@lab.test", "", ""), (n + 2, HEAD + "\n" + STUFFED * 400, "p1@lab.test", None, None), (n + 3, HEAD + "\n" + PROSE * 2000, None, "<m1>", "<m2>"), (n + 4, HEAD + "\n" + LINKS, "not an address", "<m1>", None), rows[0]]
    df = spark.createDataFrame(rows, MAILS).withColumn("host", F.lit("clash")).withColumn("x", F.lit(1)).withColumn("score", F.lit(1)).withColumn("n", F.lit(1)).repartition(5)
    got = {r["doc_id"]: r for r in spam.score_messages(df).collect()}
    assert set(got) == set(range(n + 5))
    assert got[n]["smoothed"] == 0.0 == got[n + 1]["smoothed"] and got[n]["host"] is None and got[n + 4]["host"] is None
    assert got[n + 2]["smoothed"] > 0.5 > got[n + 3]["smoothed"] and got[n + 4]["smoothed"] > 0.5
    assert spam.spam_messages(df.limit(0)).count() == 0
    strangers = df.where("from_addr IS NULL")
    assert spam.spam_messages(strangers).count() == 0  # nothing to learn from


def test_training_sample_is_bounded(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.array(*[F.lit(0.5)] * len(spam.FEATURES)).alias("x"), F.nullif(F.col("id") % 3 - 1, F.lit(-1)).cast("int").alias("label"))
    x, y = spam.training_sample(df, 600)
    assert 450 < len(y) < 760 and 0.35 < y.mean() < 0.65


@pytest.mark.parametrize("n", range(5, 12))
def test_short_link_lists(n):
    """5 to 11 bare links are as many own words; they are scored as all messages."""
    rows, _ = mailbox(6, 1500, 250)
    own = ["\n".join(mail.own_lines(r[1])) for r in rows]
    sent = np.array([0 if ".test" in r[2] else 1 for r in rows])
    prose = frozenset(w for o, s in zip(own, sent, strict=True) if not s for w in spam.distinct_words(o)) - set(OFFERS) - set(NOUNS)
    forest = spam.train_on_weak_labels(np.array([spam.features(o, prose) for o in own]), sent)
    lists = np.array([spam.features("\n".join(f"http://www.shop{i + k}.test/lamps?ref={i}" for i in range(n)), prose) for k in range(20)])
    short = np.array([spam.features(t, prose) for t in ("ok", "Thanks a lot", "Best,\nA B", "See http://docs.lab.test/page/3 before lunch, as we agreed on Monday.")])
    assert (forest.score(lists) > 0.5).all() and not (forest.score(short) > 0.5).any()
