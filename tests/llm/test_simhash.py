import random

import numpy as np
import xxhash

from riskspark.llm import simhash as S


def plain_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    runs = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_groups(rows, words=4):
    """Component ids by comparing all pairs; null ids rank last."""
    fps = [plain_fingerprint(t, words) for _, t in rows]
    left, out = set(range(len(rows))), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            i = todo.pop()
            seen.add(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= 4}
            left -= near
            todo += near
        ids = [rows[i][0] for i in seen if rows[i][0] is not None]
        out |= {i: min(ids, default=None) for i in seen}
    return [(rows[i][0], f"{fps[i]:016x}", out[i]) for i in range(len(rows))]


def order(rows):
    return sorted(rows, key=str)


def some_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 40, 200]))) for _ in range(n)]
    for i in range(n // 2):  # near copies by one or two words, and copies in upper case
        parts = texts[rng.randrange(n)].split(" ")
        for _ in range(rng.randint(0, 2)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        texts.append(" ".join(parts).upper() if i % 9 == 0 else "  ".join(parts))
    return texts


def test_fingerprints_equal_the_plain_ones():
    for text in ["", " \n", "one", "a b c", "a b c d", "É é A a", *some_texts(20)]:
        assert S.fingerprint(text.encode(), 4) == plain_fingerprint(text, 4)


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(0)
    for errors in range(5):
        for _ in range(400):
            a = int(rng.integers(0, 1 << 63)) << 1 | int(rng.integers(0, 2))
            b = a
            for bit in rng.choice(64, errors, replace=False):
                b ^= 1 << int(bit)
            keys = [set(S.keys_of(np.array([x], np.uint64).view(np.int64))[0].tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_codewords_within_four_bits():
    segments = np.random.default_rng(1).integers(0, 1 << 23, 50)
    every = [m for m in range(1 << 12)]
    codes = np.array([m << 11 for m in every])
    codes |= S._syndromes(codes)
    for segment, found in zip(segments, S.nearby_codewords(segments), strict=True):
        near = {m for m, c in zip(every, codes, strict=True) if int(segment ^ c).bit_count() <= 4}
        assert near == set(found[found >= 0].tolist()) and len(near) in (1, 6)


def test_groups_equal_all_pairs(docs, keep):
    rows = [(i * 3 % 97 + i, t) for i, t in enumerate(some_texts(120))]
    rows += [(900, None), (901, ""), (None, "zero words aside"), (None, " "), (5, "one two"), (5, "one two"), (902, "w " * 60_000)]
    got = S.near_duplicates(docs(rows, fingerprint="x", fp=1, component_id="y"), keep).collect()
    assert order(tuple(r) for r in got) == order(plain_groups(rows))


def test_blocks_of_a_crowd_lose_no_link(spark, keep, monkeypatch):
    rng = random.Random(5)
    fps = {0}
    while len(fps) < 150:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    monkeypatch.setattr(S, "BLOCK", 7)
    from riskspark.llm.common import components

    roots = components(S.links(frame, keep), keep, "roots").collect()
    assert len({r.root for r in roots}) == 1 and len(roots) == 149


def test_empty_table(docs, keep):
    assert S.near_duplicates(docs([]), keep).collect() == []
