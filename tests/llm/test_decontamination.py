import random
import re

from riskspark.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, size=10):
    """(id, number of words, covered words, items) by comparing at every word."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, covered, held = words(text), set(), set()
        for gram, ids in windows.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i : i + len(gram)]) == gram:
                    covered |= set(range(i, i + len(gram)))
                    held |= ids - {None}
        out.append((doc, len(w), sorted(covered), sorted(map(str, held))))
    return sorted(out, key=repr)


def result(rows):
    return sorted(((r.doc_id, r.n_words, [i for a, b in zip(r.hit_first, r.hit_stop, strict=True) for i in range(a, b)], r["items"]) for r in rows), key=repr)


def some(seed=1):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcéß漢1", k=rng.randint(1, 5))) for _ in range(60)]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 10, 11, 25]))) for i in range(30)]
    items += [(30, "one"), (31, None), (32, ""), (33, "?!"), (5, items[5][1]), (34, items[5][1].upper()), (None, text(14)), (35, "\U0001d49c lone letter")]
    docs = []
    for i in range(80):
        body = text(rng.choice([0, 5, 60, 200]))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1] or ""
            cut = rng.randint(0, 20)
            body += " " + part[cut:] + " " + rng.choice(["", part, "One", "ones"]) + text(3)
        docs.append((i, body))
    docs += [(7, docs[7][1]), (900, None), (901, ""), (None, items[3][1]), (902, " ".join(f"x{i}" for i in range(70_000)) + " " + items[4][1]), (903, "one"), (904, "a" * 300_000)]
    return docs, items


def test_hits_equal_plain_ones(spark, docs, keep):
    rows, items = some()
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, row string")
    got = D.contaminated(docs(rows, n_words=1, items="y", row=3, id=4), bench, keep).collect()
    assert result(got) == plain(rows, items)


def test_passes_of_parts_equal_one_pass(spark, docs, keep):
    rows, items = some(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(docs(rows), bench, keep, part_bytes=8_000).collect()
    assert result(got) == plain(rows, items)


def test_empty_tables(spark, docs, keep):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs([]), bench, keep).collect() == []
    got = D.contaminated(docs([(1, "some words here"), (2, None)]), bench, keep).collect()
    assert result(got) == [(1, 3, [], []), (2, 0, [], [])]


def test_search_finds_every_end():
    rng = random.Random(8)
    for _ in range(60):
        grams = list({b" " + bytes(rng.choices(b"ab", k=rng.randint(1, 40))) + b" " for _ in range(rng.randint(1, 12))})
        p = D.prepared(grams, D.np.arange(len(grams)))
        raw = bytes(rng.choices(b"ab ", k=5_000)) + b"".join(rng.choices(grams, k=5))
        ends, which = D.occurrences(p, raw)
        want = {(m.start(1) + len(g) - 1, i) for i, g in enumerate(grams) for m in re.finditer(b"(?=(" + g + b"))", raw)}
        assert set(zip(ends.tolist(), which.tolist(), strict=True)) == want and len(ends) == len(want)
