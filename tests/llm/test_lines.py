import random

import numpy as np
import pytest

from riskspark.llm import lines as L


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def has_word(line):
    return bool(line.strip(" \t\n\x0b\f\r"))


def plain(rows):
    places = sorted(((d is None, d or 0, r, k), line) for r, (d, t) in enumerate(rows) for k, line in enumerate((t or "").split("\n")) if has_word(line))
    first, out = {}, [[] for _ in rows]
    for place, line in places:
        first.setdefault(line, place)
    late = {x for x in first if any(first[y] < first[x] and near(x, y) for y in first if y != x)}
    drops = {place[2:] for place, line in places if first[line] != place or line in late}
    for r, (d, t) in enumerate(rows):
        split = (t or "").split("\n")
        kept = None if t is None else "\n".join(x for k, x in enumerate(split) if (r, k) not in drops)
        out[r] = (d, kept, sum(map(has_word, split)), sum(x[0] == r for x in drops))
    return out


def order(rows):
    return sorted(rows, key=str)


def some_rows(seed=1):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abé ", k=rng.randint(1, 12))) for _ in range(60)] + ["a line that many documents share, " * 5]
    rows = []
    for i in range(80):
        picked = [rng.choice(pool) for _ in range(rng.randint(0, 8))]
        for k, line in enumerate(picked):
            if line and rng.random() < 0.5:
                at = rng.randrange(len(line))
                picked[k] = rng.choice([line[:at] + line[at + 1 :], line[:at] + rng.choice("xyz🙂") + line[at:], line[:at] + "q" + line[at + 1 :]])
        rows.append((i, "\n".join(picked)))
    return rows


def test_equal_to_all_pairs(docs, keep):
    rows = some_rows() + [(200, None), (201, ""), (202, " \n\t"), (None, "last of all\nand this"), (3, "last of all\nnot this"), (3, "last of all"), (205, "x" * 30_000), (206, "x" * 29_999 + "y")]
    got = L.deduplicated(docs(rows, n_lines="clash", row=1, x=2).coalesce(1), keep).collect()
    assert order((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == order(plain(rows))
    assert got[0].row == 1 and got[0].x == 2


def test_documents_without_a_line_left_go(docs, keep):
    got = L.remaining(docs([(1, "one line\ntwo line"), (2, "one line"), (3, None), (4, " ")]), keep).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 4]


def test_empty_table(docs, keep):
    assert L.deduplicated(docs([]), keep).collect() == []


@pytest.mark.parametrize("step", [5, 40, 1000])
def test_hashes_of_stretches_and_variants(step, monkeypatch):
    monkeypatch.setattr(L, "STEP", step)
    texts = [b"abcd\n\nabXd", "é🙂\nabcd".encode(), b"", b"abd"]
    found = {}
    for codes, row, number, start, end in L.steps([0, 1, 2, 3], texts):
        h = L.Hashes(codes, 0)
        for r, n, s, e, x in zip(row, number, start, end, h.of(start, end), strict=True):
            found[int(r), int(n)] = x
            line = texts[r].decode().split("\n")[n]
            assert "".join(map(chr, codes[s:e])) == line
            whole = L.Hashes(np.frombuffer(line.encode("utf-32-le"), np.uint32), 0)
            for at in range(len(line)):
                rest = line[:at] + line[at + 1 :]
                other = L.Hashes(np.frombuffer(rest.encode("utf-32-le"), np.uint32), 0)
                assert whole.without(0, len(line), np.array([at]))[0] == other.of(np.array([0]), np.array([len(rest)]))[0]
    assert found[0, 0] == found[1, 1] and len(found) == 5
