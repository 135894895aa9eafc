import random
import re
import zlib
from collections import Counter

from riskspark.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """(word, form, root, n, n_near, form_n) by comparing all pairs."""
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and x != w and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def result(rows):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n) for r in rows)


def some(seed=0, words=40, letters="abcÄäß"):
    rng = random.Random(seed)
    pool = ["".join(rng.choices(letters, k=rng.randint(6, 11))) for _ in range(words)]
    for w in pool[: words // 2]:  # chains of variants
        for _ in range(4):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            w = w[:i] + ("" if kind == 1 else rng.choice(letters)) + w[i + (kind > 0) :]
            pool.append(w)
    weights = [rng.choice([1, 2, 3, 30, 300]) for _ in pool]
    rows = [(i, " ".join(rng.choices(pool, weights, k=150)) + rng.choice(["", "x÷y×zabcdefg", " 漢字abcdefg1abcdefh"])) for i in range(60)]
    return rows + [(1, None), (2, ""), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (4, "w" * 60_000 + " " + "w" * 60_000 + " " + "w" * 59_999), (5, "q" * 900 + " " + "q" * 901 + " " + "q" * 900 + " " + "q" * 901)]


def test_variants_equal_all_pairs(docs, keep):
    for seed, letters in ((0, "abcÄäß"), (1, "abcdefghijklmnopqrstuvwxyzàé")):
        rows = some(seed, letters=letters)
        assert result(S.variants(docs(rows, word="x", n=1, key=2), keep).collect()) == plain(rows)


def test_blocks_lose_no_pair(docs, keep, monkeypatch):
    rows = some(3, 60, "ab")
    monkeypatch.setattr(S, "STORED_LETTERS", 60)
    monkeypatch.setattr(S, "ASKING_LETTERS", 200)
    monkeypatch.setattr(S, "TOGETHER", 300)
    monkeypatch.setattr(S, "UNDER_WAY", 50)
    monkeypatch.setattr(S, "CELLS", 700)
    assert result(S.variants(docs(rows), keep).collect()) == plain(rows)


def test_chains_lead_to_the_last_form(docs, keep):
    words = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb"]
    text = " ".join(" ".join([w] * 3 * 10**i) for i, w in enumerate(words))
    rows = [(0, text)]
    got = result(S.variants(docs(rows), keep).collect())
    assert got == plain(rows) and {r[2] for r in got if r[0] in words} == {words[-1]}


def test_empty_table(docs, keep):
    assert S.variants(docs([]), keep).collect() == []
    assert S.variants(docs([(1, None), (2, "short words")]), keep).collect() == []
