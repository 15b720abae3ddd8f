import random

from veska.llm.leakage import K, WINDOW, Coder, Items, find_leaks, kgrams, leaks_of, plain_words, unify, winnow

ITEMS_N = 60


def items(seed=0):
    rnd = random.Random(seed)
    things = ["sacks of flour", "litres of oil", "carts of logs", "pairs of boots"]
    who = ["the clerk", "the ferry keeper", "the auditor", "a night warden"]
    out = []
    for i in range(ITEMS_N):
        s = " ".join(f"In sheet {rnd.randint(1000, 99999)} {rnd.choice(who)} in Town{rnd.randint(100, 999)} counted {rnd.randint(1000, 99999)} {rnd.choice(things)}, page {rnd.randint(1000, 99999)}." for _ in range(6))
        out.append((i, f"Read the passage with care and then answer the question that follows below it. {s} Who signed the sheet?"))
    return out


FILL = "the weather was calm and people went to the market in the morning "


def documents():
    rnd = random.Random(1)
    its = dict(items())
    body = {i: its[i].split("below it. ")[1].split(" Who signed")[0] for i in its}
    docs, truth = [], set()

    def add(text, *leaked):
        docs.append((len(docs), text))
        truth.update((len(docs) - 1, i) for i in leaked)

    add(FILL * 5 + body[0] + FILL, 0)
    add(body[1].upper().replace(".", " ;"), 1)
    add("<p>" + body[2].replace(" ", "</b> <b>", 4).replace(" counted", "\n> counted") + "</p>", 2)
    add(body[3].replace("a", "а").replace("o", "о"), 3)  # Cyrillic letters
    w = body[4].split()
    for k in range(7, len(w), 9):
        w[k] = "changed" if not any(c.isdigit() for c in w[k]) else w[k]
    add(" ".join(w), 4)
    w = body[5].split()
    del w[6], w[20]
    w.insert(13, "really")
    add(FILL * 300 + " ".join(w) + FILL * 300, 5)
    add(" ".join(body[6].split()[:14]), 6)
    add(body[7] + FILL + body[8], 7, 8)
    add("".join(c + "­" if rnd.random() < 0.2 else c for c in body[9]), 9)
    # No leaks: other numbers and places, lead-ins, few words, nothing.
    import re

    add(re.sub(r"\d+", lambda m: str(rnd.randint(1000, 99999)), body[10]))
    add(its[11].split(" In sheet")[0] + FILL + "Who signed the sheet?")
    add(FILL + " ".join(body[12].split()[:7]) + " " + FILL)
    add(FILL * 20)
    return docs, truth


def run(spark, docs, its, extra=True):
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id bigint, text string, item_id int, words string")
    i = spark.createDataFrame([(k, t, "y") for k, t in its], "item_id bigint, text string, doc_id string")
    return find_leaks(d, "doc_id", "text", i, "item_id", "text")


def test_leaks(spark):
    docs, truth = documents()
    rows = run(spark, docs + [(100, None), (101, ""), (102, " \n"), (103, "x" * 100_000)], items() + [(900, None), (901, ""), (902, "few words")]).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth
    assert all(r.words >= 12 for r in rows)


def test_blocks_and_repeats(spark, monkeypatch):
    import veska.llm.leakage as lk

    docs, truth = documents()
    assert run(spark, docs + docs[:1], items() + items()[:2]).count() == len(truth) + 1
    monkeypatch.setattr(lk, "BLOCK", 25)
    got = {(r.doc_id, r.item_id) for r in run(spark, docs, items()).collect()}
    assert got == truth


def test_empty(spark):
    docs, _ = documents()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items(), "item_id bigint, text string")
    assert find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_winnowing_keeps_every_long_shared_span():
    rnd = random.Random(2)
    import numpy as np

    known = Items(items(), np.zeros(0, np.uint64), np.zeros(0, np.int64))

    for _ in range(200):
        item = known.coded[rnd.randrange(ITEMS_N)]
        n = K + WINDOW - 1
        a = rnd.randrange(20, len(item) - n)
        doc = np.concatenate([np.full(rnd.randrange(3, 9), 0), item[a : a + n], np.full(5, 0)])
        at = winnow(kgrams(doc))
        assert set(kgrams(doc)[at].tolist()) & set(kgrams(item).tolist())


def test_words():
    assert plain_words("A&nbsp;<b>b</b>-c_d hy-\nphen") == ["a", "b", "c", "d", "hyphen"]
    assert unify("мoлoкo") == "молоко" and unify("hоuse") == "house"


def _items_of_words(n=150):
    rnd = random.Random(8)
    return [(i, " ".join(f"word{rnd.randrange(4000)}" for _ in range(60))) for i in range(n)]


def test_recall_with_words_changed_lost_and_added():
    """At least nine of ten passages are found with up to three of their words changed, lost
    or added, as long as ten words stay."""
    import numpy as np

    rnd, its = random.Random(9), _items_of_words()
    known = Items(its, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    code = Coder(known.code)
    for words in (12, 16, 24):
        for changes in range(0, min(4, words - 9)):
            found = 0
            for _ in range(200):
                k = rnd.randrange(len(its))
                a = rnd.randrange(0, 60 - words)
                w = its[k][1].split()[a : a + words]
                for at in sorted(rnd.sample(range(1, words - 1), changes), reverse=True):
                    how = rnd.choice(["change", "change", "lose", "add"]) if words > 12 else "change"
                    w[at : at + 1] = {"change": ["other"], "lose": [], "add": [w[at], "other"]}[how]
                text = FILL.split() * 3 + w + FILL.split()
                found += k in {i for i, _ in leaks_of(np.array([code[x] for x in text], np.int64), known)}
            assert found >= 0.9 * 200, (words, changes, found)
    for k in range(50):  # every fifth word changed
        w = its[k][1].split()[10:34]
        w[4::5] = ["other"] * len(w[4::5])
        assert k in {i for i, _ in leaks_of(np.array([code[x] for x in w], np.int64), known)}


def test_stock_is_counted_over_the_whole_list(spark, monkeypatch):
    """A lead-in that six items share is stock whatever the list's size and blocks; copies of
    one item are one text and leak all."""
    import veska.llm.leakage as lk

    lead = " ".join(f"lead{i}" for i in range(20))
    its = _items_of_words(40)
    shared = [(k, f"{lead} {t}") if k < 6 else (k, t) for k, t in its] + [(100 + k, its[30][1]) for k in range(8)]
    docs = [(0, lead), (1, its[30][1])]
    want = {(1, 30), *((1, 100 + k) for k in range(8))}
    for block in (20_000, 3):
        monkeypatch.setattr(lk, "BLOCK", block)
        assert {(r.doc_id, r.item_id) for r in run(spark, docs, shared).collect()} == want


def test_passage_of_stock_phrases(spark, monkeypatch):
    """A passage whose 3-grams are each in more than four texts is found if the whole is in
    one; a phrase of many texts, changed or beside a question, is none."""
    import veska.llm.leakage as lk

    rnd = random.Random(10)
    fill = lambda n: " ".join(f"fill{rnd.randrange(30_000)}" for _ in range(n))
    passage = [f"part{j}" for j in range(14)]
    texts = [f"{fill(20)} {' '.join(passage)} {fill(20)}"]
    texts += [f"{fill(9)} {' '.join(passage[j : j + 3])} {fill(9)}" for j in range(12) for _ in range(5)]
    lead, question = " ".join(f"lead{j}" for j in range(20)), " ".join(f"ask{j}" for j in range(8))
    texts += [f"{lead} {fill(20)} {question}" for _ in range(6)]
    changed = passage[:5] + ["other"] + passage[6:]
    docs = [
        (0, FILL + " ".join(passage) + " " + FILL),
        (1, FILL + " ".join(changed) + " " + FILL),
        (2, (" " + FILL).join(" ".join(passage[j : j + 3]) for j in range(0, 12, 3))),
        (3, FILL + lead.replace("lead9", "other") + " " + FILL + question),
        (4, f"{lead} {question} {FILL}"),
    ]
    for more, block in ((0, 20_000), (0, 30), (1500, 20_000)):  # with 1,500 more texts its words are those of few
        monkeypatch.setattr(lk, "BLOCK", block)
        its = list(enumerate(texts + [fill(15) for _ in range(more)]))
        assert {(r.doc_id, r.item_id) for r in run(spark, docs, its).collect()} == {(0, 0), (1, 0)}, (more, block)


def test_stock_phrases_are_measured_exactly(spark):
    """The longest run from every word on that more than four texts have, against counting."""
    import numpy as np

    from veska.llm.leakage import STOCK, coded, phrases_of, stock_of

    rnd = random.Random(11)
    texts = [" ".join(rnd.choice("abc") + "x" for _ in range(40)) for _ in range(12)] + ["ax bx " * 15 + t for t in "abcdef"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    stock, _ = stock_of(d, "text")
    phrases = phrases_of(d, "text", stock)
    words = [t.split() for t in texts]
    having = lambda run: sum(any(w[k : k + len(run)] == run for k in range(len(w) - len(run) + 1)) for w in words)
    for t, w in zip(texts, words):
        want = [max((n for n in range(K, len(w) - i + 1) if having(w[i : i + n]) > STOCK), default=0) for i in range(len(w))]
        assert phrases.lengths(coded(t), np.sort(stock)).tolist() == want
