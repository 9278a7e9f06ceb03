"""Repeated passages of short sentences, and of few long ones."""
import random

ROWS = "doc_id long, text string"


def removed(spark, texts):
    from tablecraft.llm.sentences import drop_repeated_sentences
    df = spark.createDataFrame(list(enumerate(texts)), ROWS).repartition(3)
    return {r.doc_id: (r.n_removed, r.n_sentences, r.text) for r in drop_repeated_sentences(df, run=None).collect()}


def test_copies_of_short_sentences(spark):
    rnd = random.Random(6)
    words = [f"w{rnd.randint(0, 400)}" for _ in range(155)]
    shouted = "!! ".join(words) + "!!"
    pairs = ". ".join(" ".join(words[k:k + 2]) for k in range(0, 154, 2))
    got = removed(spark, [shouted, pairs, shouted, pairs, "of its own. " + shouted, "Yes. No. Who?", "Yes. No. Who?", "Yes.", "Yes."])
    assert all(got[k][0] == 0 for k in (0, 1, 5, 7, 8))
    assert got[2][0] == got[2][1] == 155 and got[3][0] == got[3][1] == 77 and got[6][0] == 3
    assert got[4] == (155, 156, "of its own. ")


def test_passages_of_fewer_than_three_sentences(spark):
    rnd = random.Random(7)
    said = lambda n: " ".join(f"w{rnd.randint(0, 10**9)}" for _ in range(n))
    one, two = said(60) + ". ", said(30) + ". " + said(25) + ". "
    short = said(20) + ". Yes. "                             # the second sentence is below the minimum
    texts = [said(9) + ". " + x + said(9) + "." for x in (one, one, two, two, short, short)]
    got = removed(spark, texts)
    assert [got[k][0] for k in range(6)] == [0, 1, 0, 2, 0, 2]
    assert all(got[k][2] == texts[k].replace(x, "") for k, x in ((1, one), (3, two), (5, short)))


def test_every_repeated_run_is_covered(spark):
    """Against all runs of whole sentences, of any length."""
    rnd = random.Random(8)
    pool = [[f"s{k}x{j}" for j in range(rnd.choice((1, 1, 2, 3, 5, 9, 14)))] for k in range(12)]
    docs = [[rnd.randrange(12) for _ in range(rnd.randint(0, 14))] for _ in range(60)]
    want, seen = [], set()
    for d in docs:
        gone, own = set(), set()
        for a in range(len(d)):
            for b in range(a + 1, len(d) + 1):
                run, words = tuple(d[a:b]), sum(len(pool[k]) for k in d[a:b])
                if words >= 8 or (b == len(d) and b - a >= 3):
                    key = (run, words < 8)                   # short ends meet short ends
                    gone |= set(range(a, b)) if key in seen or key in own else set()
                    own.add(key)
        seen |= own
        want.append(len(gone))
    got = removed(spark, [" ".join(" ".join(pool[k]) + "." for k in d) for d in docs])
    assert [got[k][0] for k in range(60)] == want and sum(want) > 0
