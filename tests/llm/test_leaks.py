import random
import re

from lodestrand.llm import leaks as L
from tests.conftest import rows


def brute(docs, items, n=8):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in docs:
        text = f" {' '.join(w(t))} "
        for i, x in items:
            ws = w(x)
            if any(f" {' '.join(ws[k : k + n])} " in text for k in range(len(ws) - n + 1)):
                out.add((d, i))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t, "s", "k") for i, t in items], "item_id long, text string, suite string, task string")


def test_against_brute_force(spark):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(25)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(r.randrange(5, 40)))) for i in range(30)]
    docs = []
    for d in range(300):
        ws = say(r.randrange(0, 60))
        if d % 2:
            src = items[r.randrange(30)][1].split()
            n = r.randrange(5, 12)
            at = r.randrange(0, max(1, len(src) - n))
            k = r.randrange(len(ws) + 1)
            ws[k:k] = src[at : at + n]
        docs.append((d, r.choice([" ", ", ", "\n", " -- "]).join(w.upper() if r.random() < 0.3 else w for w in ws)))
    docs += [(900, None), (901, ""), (902, docs[1][1]), (902, docs[1][1])]
    items += [(77, items[0][1]), (78, None), (79, "too short"), (0, items[0][1])]
    got = rows(L.leaks_found(*frames(spark, docs, items)))
    assert got == brute(docs, items) and len(got) > 50


def test_boundary(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, "x ONE two-three, four. five\nsix `seven` eight y"), (2, "one two three four five six seven x eight"), (3, "two three four five six seven eight nine"), (4, "twoo three four five six seven eight nine x")]
    assert rows(L.leaks_found(*frames(spark, docs, [(5, item)]))) == [(1, 5), (3, 5)]


def test_full_filter_loses_nothing(spark):
    """A filter of 64 bits lets nearly all through: the same rows by the same plan."""
    r = random.Random(2)
    say = lambda n: " ".join(f"w{r.randrange(30)}" for _ in range(n))
    items = [(i, say(30)) for i in range(10)]
    docs = [(d, say(20) + " " + (" ".join(items[d % 10][1].split()[3 : 3 + d % 14]))) for d in range(60)]
    d, i = frames(spark, docs, items)
    assert rows(L.leaks(d, i, bits=64)) == rows(L.leaks(d, i)) == brute(docs, items)


def test_hot_passage(spark):
    """A passage in most documents and items: every pair comes out."""
    passage = "all of this text is shared by very many of them"
    docs = [(k, f"a{k} b{k} {passage} c{k}") for k in range(400)] + [(k, f"x{k}") for k in range(400, 500)]
    items = [(k, f"{passage} q{k} r{k}") for k in range(20)]
    assert L.leaks_found(*frames(spark, docs, items)).count() == 400 * 20


def test_empty(spark):
    d, i = frames(spark, [(1, "a b c")], [(1, "a b")])
    assert rows(L.leaks_found(d.limit(0), i)) == [] and rows(L.leaks_found(d, i.limit(0))) == []


def test_prefix_is_a_part(spark):
    d, i = frames(spark, [(1, "nothing")], [(1, " ".join(f"w{k}" for k in range(60)))])
    s = L.item_shingles(i)
    kept = L.prefix_tokens(s, L.shingle_counts(L.scan(d, s))).collect()
    at = sorted(r.pos for r in kept)
    assert len(at) < 57 and all(b - a <= 5 for a, b in zip(at, at[1:])) and at[0] < 5 and at[-1] > 51
