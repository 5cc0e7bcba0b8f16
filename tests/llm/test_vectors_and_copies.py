"""Clusters, hard negatives and exact duplicates against plain versions, on rows with nulls, ties, repeats and clashing columns."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from feedsift.llm import clusters, exact, negatives
from feedsift.llm.queries import MINED_LABEL
from feedsift.llm.scratch import importable

VECTOR = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, cluster STRING, distance STRING, rank STRING, data STRING, key INT"
DOCUMENT = "doc_id BIGINT, text STRING, name STRING, level STRING, task STRING, ref STRING, kept INT"


def same(found, wanted):
    assert Counter(map(repr, found)) == Counter(map(repr, wanted))


def vectors(dims=64):
    rng = random.Random(3)

    def vector():
        return [rng.gauss(0, 0.125) for _ in range(dims)]

    centre, hot = vector(), vector()
    found = [(n, vector(), n % 4) for n in range(300)]
    found += [(300 + n, [x + rng.gauss(0, 0.01) for x in centre], n % 3) for n in range(150)]
    found += [(450 + n, hot, n % 2) for n in range(200)]  # copies: every score and distance ties
    found += [(700, None, 1), (701, [], 1), (702, [0.0] * dims, 1), (703, [math.nan] + hot[1:], 2), (704, [math.inf] + hot[1:], 2)]
    found += [(800, [None] + hot[1:], 2), (706, hot[:5], 2), (900, hot[:5], 2), (707, centre[:5], 1), (708, hot, None), (None, hot, 1)]
    found += [(709, [3.0e4] * dims, 3), (710, [-3.0e4] * dims, 3), (1000, centre, 2), (1000, centre, 2), (1000, hot, 1)]
    rng.shuffle(found)
    return found


def frame(spark, rows):
    importable(spark)
    return spark.createDataFrame([(i, e, k, "c", "d", "r", "x", 1) for i, e, k in rows], VECTOR).repartition(5)


def usable(e):
    return e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e)


def plain_clusters(rows):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e, _ in rows if usable(e) and len(e) == 64]
    first = sorted(kept, key=lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in first[:8]]

    def assigned():
        out = []
        for _, x in kept:
            away = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
            out.append((min(away), away.index(min(away))))
        return out

    for _ in range(10):
        near = assigned()
        for k in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, near, strict=True) if c == k]
            if own:
                centroids[k] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    near = assigned()
    sums = Counter()
    for d, c in near:
        sums[c] += d
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, sums[c], sum(sums.values()), names[c]) for (i, _), (d, c) in zip(kept, near, strict=True)]


@pytest.mark.parametrize("n", [0, 5, 10_000])
def test_clusters(spark, n):
    rows = vectors()[:n]
    found = clusters.cluster_vectors(frame(spark, rows)).collect()
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    same([tuple(r[c] for c in names) for r in found], plain_clusters(rows))


def test_curve_visits_every_cell_and_moves_one_step_at_a_time():
    for dims, bits in ((2, 1), (2, 4), (3, 3), (5, 2), (8, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = clusters.curve_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_keep_every_nearest_centroid():
    rng = np.random.default_rng(1)
    spared = 0
    for spread in (3, 40, 400):
        for _ in range(50):
            x = rng.integers(-500, 500, 6) + rng.integers(0, spread, (20, 6))
            centroids = rng.integers(-500, 500, (8, 6))
            found = clusters.candidates(x.min(axis=0), x.max(axis=0), centroids)
            away = ((x[:, None] - centroids) ** 2).sum(axis=2)
            assert set(away.argmin(axis=1)) <= set(found.tolist())
            assert (clusters.distances(x, centroids) == away).all()
            spared += 8 - len(found)
    assert spared > 500


def test_distances_beyond_exact_doubles():
    x, centroids = np.array([[1 << 27, 3], [-(1 << 27), 5]]), np.array([[-(1 << 27), 4], [0, 0]])
    wanted = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for v in x]
    assert clusters.distances(x, centroids).tolist() == wanted


def plain_negatives(rows):
    kept = []
    for i, e, k in rows:
        if i is not None and k is not None and usable(e):
            kept.append((i, (k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * x) for x in e]))
    out = []
    for a, k, x in kept:
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), b, own == k) for b, own, y in kept if b != a and len(y) == len(x)]
        for s, p, _ in sorted(r for r in scored if r[2])[:5]:
            fit = sorted(r for r in scored if not r[2] and 80 * -s <= 100 * -r[0] <= 100 * -s)[:5]
            out += [(a, p, n + 1, b, -s, -t) for n, (t, b, _) in enumerate(fit)]
    return out


@pytest.mark.parametrize("n", [0, 40, 10_000])
def test_hard_negatives(spark, monkeypatch, n):
    rows = vectors()[:n]
    wanted = plain_negatives(rows)
    assert n < 10_000 or len(wanted) > 100
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

    def ask():
        return [tuple(r[c] for c in names) for r in negatives.hard_negatives(frame(spark, rows), MINED_LABEL).collect()]

    same(ask(), wanted)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    same(ask(), wanted)


def test_bounds_hold_every_product_and_leave_windows_out():
    rng = np.random.default_rng(2)
    references = rng.normal(size=(6, 8))
    references /= np.linalg.norm(references, axis=1)[:, None]

    def angles(v):
        norm = np.linalg.norm(v, axis=1)[:, None]
        return np.arccos(np.clip((v / np.where(norm > 0, norm, 1)) @ references.T, -1, 1)), norm[:, 0]

    left_out = 0
    for trial in range(60):
        anchors = np.concatenate([rng.integers(-99, 99, (10, 8)), np.zeros((1, 8), int), np.rint(references * 90).astype(int)])
        rows = np.rint(references[trial % 6] * 80 + rng.normal(size=(12, 8)) * (trial % 3)).astype(int)
        if trial % 4 == 0:
            rows[0] = 0
        (own, norm), (theirs, sizes) = angles(anchors), angles(rows)
        chunk = negatives.Anchors(np.arange(17), np.zeros(17), norm, anchors, own)
        block = {
            "angle_low": theirs.min(axis=0).tobytes(), "angle_high": theirs.max(axis=0).tobytes(),
            "norm_low": sizes.min(), "norm_high": sizes.max(),
        }
        least, most = negatives.bounds(chunk, block, np.arange(17))
        found = anchors @ rows.T
        assert (least <= found.min(axis=1)).all() and (found.max(axis=1) <= most).all()
        left_out += (most < 0.8 * norm * sizes.max()).sum()
    assert left_out > 100


def documents():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeé漢", k=5)) for _ in range(300)]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\r\n", "\x0b\x0c"]) for _ in range(n))

    long, longer = text(3000), text(9000)
    texts = [text(rng.randint(1, 60)) for _ in range(50)] + [long, longer] * 3
    texts += [re.sub(r"[\x20\x09-\x0D]", "", t) for t in (long, longer, texts[0])] + [long[:-1] + "x", "x" + long, long + long]
    texts += ["same text here"] * 60 + ["same  text here", "sametexthere", " same text\nhere "] * 5
    texts += ["", " ", "\n\t", None, None, "\x00", " ", "\xa0", "\x85", "\x1f"]
    texts += ["b" * n for n in (2047, 2048, 2049, 4096, 4097, 6144)] + ["b" * 2048 + "\n" + "b" * 2048]
    rows = [(n, t) for n, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[3]), (None, long), (None, None), (None, "alone"), (None, "alone"), (3, texts[4]), (2, " " + texts[3])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("known", [0, 5000, 64 << 20])
@pytest.mark.parametrize("n", [0, 10_000])
def test_exact_duplicates(spark, monkeypatch, known, n):
    monkeypatch.setattr(exact, "KNOWN_BYTES", known)
    importable(spark)
    rows = documents()[:n]
    table = spark.createDataFrame([(i, t, "n", "l", "t", "r", 1) for i, t in rows], DOCUMENT).repartition(6)
    groups = defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, i))
    wanted = []
    for t, members in groups.items():
        members.sort()
        digest = sha256(t.encode()).hexdigest()
        wanted += [(i, members[0][3], len(members), place == 0, digest) for place, (_, _, _, i) in enumerate(members)]
    found = exact.exact_duplicates(table).collect()
    same([tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in found], wanted)
