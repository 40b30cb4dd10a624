"""Links, near copies, repeated lines, toxicity, search, language model and the pipeline against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from stillwell.llm import line_dedup, lm, minhash, toxicity
from stillwell.llm.ann import Projected, nearest_vectors
from stillwell.llm.linkage import bucket_links, components
from stillwell.llm.shingles import shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def closure(nodes, links):
    best = {n: n for n in nodes}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for n in sorted(best):
        todo = [n] if best[n] == n else []
        while todo:
            for m in near[todo.pop()]:
                if best[m] > n:
                    best[m] = n
                    todo.append(m)
    return best


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(20, 40)] + [(50, k) for k in range(51, 90)] + [(7, 99), (99, 8), (3, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == closure({n for e in edges for n in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bucket_links_lose_no_link(spark):
    rng = np.random.default_rng(2)
    # one bucket of 150 nodes, small buckets and overlaps; links are given by residues, so stars alone would miss some
    members = [(0, k) for k in range(150)] + [(int(b), int(n)) for b, n in zip(rng.integers(1, 60, 200), rng.integers(100, 260, 200))]
    members = sorted(set(members))

    def linked(a, b):
        return a // 40 == b // 40 and (a + b) % 3 == 0

    from pyspark.sql import functions as F
    same = (F.floor(F.col("a") / 40) == F.floor(F.col("b") / 40)) & ((F.col("a") + F.col("b")) % 3 == 0)
    _, groups = bucket_links(spark.createDataFrame(members, "bucket long, node long"), lambda pairs: pairs.filter(same))
    buckets = defaultdict(list)
    for b, n in members:
        buckets[b].append(n)
    links = [(x, y) for nodes in buckets.values() for x in nodes for y in nodes if x < y and linked(x, y)]
    want = {n: c for n, c in closure({n for _, n in members}, links).items() if any(n in e for e in links)}
    assert dict(map(tuple, groups.collect())) == want


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "É", "\x1c", " ", "\n", "\t", "cc"]), max_size=30))
def test_shingle_sets_have_the_plain_size(parts):
    text = "".join(p + (" " if i % 2 else "") for i, p in enumerate(parts))
    assert len(shingle_set(text)) == len(plain_shingles(text))


def test_min_and_max_agree_with_chance_of_similarity():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    one, two = np.unique(values[:3000]), np.unique(values[1000:])
    low, high = minhash.min_max(one), minhash.min_max(two)
    agree = np.concatenate([low[0] == high[0], low[1] == high[1]]).mean()
    assert abs(agree - 0.5) < 0.15


def words(rng, count):
    return ["".join(rng.choice(list("abcdefghijk"), 4)) for _ in range(count)]


def near_corpus(rng):
    texts = ["", None, "one", "one two", "One TWO", " ", "x y z w v", "X Y Z w v"]
    for _ in range(6):
        base = words(rng, 120)
        for _ in range(5):
            copy = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 6)):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    hot = words(rng, 60)
    texts += [" ".join(hot)] * 30
    texts += [" ".join([*hot[:50], *words(rng, 2), *hot[50:]]) for _ in range(30)]
    texts.append(" ".join(words(rng, 30_000)))
    return texts


def test_near_groups_against_all_pairs(spark):
    texts = near_corpus(np.random.default_rng(9))
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(texts))]
    rows = [(i, t, "l", "s", 1) for i, t in zip(ids, texts)]
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    sets = {i: plain_shingles(t) for i, t in zip(ids, texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = closure(ids, links)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_near_groups_of_odd_rows(spark):
    rows = [(None, "a b c d e f", "", "", 0), (4, "a b c d e f", "", "", 0), (4, "a b c d e f", "", "", 0), (2, "A b c d e f", "", "", 0), (None, None, "", "", 0)]
    got = sorted(map(str, map(tuple, minhash.near_groups(spark.createDataFrame(rows, DOCS)).collect())))
    assert got == sorted(map(str, [(None, 2, 2, False), (4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (None, 0, None, True)]))
    assert minhash.near_groups(spark.createDataFrame([], DOCS)).collect() == []


def plain_simhash(line):
    import xxhash
    hashes = [xxhash.xxh64_intdigest(w) for w in [w for w in line.split() if len(w) > 3] or line.split()]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "ccc", "dddd"]), max_size=12).map(" ".join), max_size=8))
def test_simhashes_bit_by_bit(lines):
    assert line_dedup.simhashes(lines).tolist() == [plain_simhash(x) for x in lines]


def line_rows(rng):
    base = [" ".join(words(rng, 40)) for _ in range(6)]
    texts = ["", None, "\n\n", "!!!", "Same line.\nsame  LINE", "Same line\nown words here"]
    for k in range(14):
        parts = base[k % 6].split()
        if k % 3:
            parts[int(rng.integers(40))] += "z"
        texts.append("\n".join(["intro %s" % words(rng, 2), " ".join(parts), "", "tail?"]))
    return [(int(i), t, "l", "s", 1) for i, t in zip(rng.permutation(len(texts)), texts)]


def plain_lines(rows):
    places = {}
    for i, t, *_ in rows:
        for n, line in enumerate((t or "").split("\n")):
            normal = re.sub(r"[\W_]+", " ", line).lower().strip()
            if normal:
                places[i, n] = normal
    keys = sorted(places)
    sims = {p: plain_simhash(places[p]) for p in keys}

    def linked(a, b):
        x, y = places[a], places[b]
        longer = max(len(x), len(y))
        return x == y or (bin(sims[a] ^ sims[b]).count("1") <= 3 and 10 * edits(x, y) <= longer)

    best = closure(keys, [(a, b) for a in keys for b in keys if a < b and linked(a, b)])
    return {p: best[p] == p for p in keys}


def test_repeated_lines_against_all_pairs(spark):
    rows = line_rows(np.random.default_rng(8))
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.line): r.kept for r in line_dedup.repeated_lines(docs).collect()}
    want = plain_lines(rows)
    assert got == want and 0 < sum(want.values()) < len(want)
    clean = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    for i, t, *_ in rows:
        gone = {n for (d, n), kept in want.items() if d == i and not kept}
        left = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone)
        if gone and not any(d == i and kept for (d, _), kept in want.items()):
            assert i not in clean
        else:
            assert clean[i].text == (left if gone else t) and clean[i].n_chars == (len(left) if gone else 1)


def test_repeated_lines_of_odd_rows(spark):
    rows = [(None, "alpha beta", "", "", 0), (1, "alpha beta", "", "", 0), (1, "alpha beta", "", "", 0), (1, "gamma delta\nalpha beta", "", "", 0)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.text for r in got if r.doc_id == 1) in (["alpha beta", "alpha beta", "gamma delta"], ["gamma delta\nalpha beta"])
    assert [r.text for r in got if r.doc_id is None] == ["alpha beta"]
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS)).collect() == []


def toxic_rows(rng, count):
    bad = ["vileword", "nastyish", "scumlike"]
    docs, labels = [], []
    for i in range(count):
        toxic = i % 4 == 0
        text = words(rng, 60) + [str(b) for b in rng.choice(bad, 1 + i % 7)] * toxic
        rng.shuffle(text)
        docs.append((i, " ".join(text).title() if i % 3 else " ".join(text), "l", "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_rows(np.random.default_rng(6), 400)
    docs += [(1000, None, "l", "s", 0), (1001, "", "l", "s", 0), (None, "Nastyish!!", "l", "s", 0)]
    frame = spark.createDataFrame(docs, DOCS)
    learn = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, learn)
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert all(got[i].toxic == bool(toxic) for i, _, toxic in labels[200:])
    assert not got[1000].toxic and not got[1001].toxic and got[None].toxic
    assert np.all(np.diff(model.thresholds) > 0) and all(0 <= r.severity <= 3 for r in got.values())
    kept = toxicity.drop_toxic(frame, learn).collect()
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(str(i) for i, r in got.items() if not r.toxic)
    assert toxicity.fit(frame, learn.limit(0)) is None
    assert {r.severity for r in toxicity.score(frame, None).collect()} == {0.0}
    assert toxicity.score(frame.limit(0), model).collect() == []


def test_ordinal_fit_shares_weights_over_thresholds():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, toxicity.GRADES, 600)
    # feature k is present from grade k on
    rows, columns = zip(*[(i, k) for i, g in enumerate(grades) for k in range(1, g + 1)])
    weights, cuts = toxicity.fit_ordinal(np.array(rows), np.array(columns) - 1, grades, 3)
    model = toxicity.Model({}, cuts)
    scores = np.array([weights[:g].sum() for g in range(4)])
    assert model.probabilities(scores).argmax(axis=1).tolist() == [0, 1, 2, 3]
    assert np.allclose(model.probabilities(scores).sum(axis=1), 1)


def test_search_recall_and_ties():
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 24))
    vectors[100:140] = vectors[100]
    ids = np.arange(3000)[::-1].copy()
    block = Projected(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hit = 0
    for q in range(0, 3000, 60):
        rows, scores = block.nearest(vectors[q], ids == ids[q], ids, 5)
        want = unit @ unit[q]
        want[q] = -9
        hit += len({*np.lexsort((ids, -want.round(12)))[:5]} & {*rows})
        assert np.allclose(scores, unit[rows] @ unit[q])
    assert hit / 250 >= 0.9
    rows, scores = block.nearest(vectors[100], ids == ids[100], ids, 5)
    assert ids[rows].tolist() == [2860, 2861, 2862, 2863, 2864] and len(set(scores)) == 1


def test_nearest_vectors_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (7, [0.0, 1.0]),
            (8, [2.0, 0.2]), (8, [2.0, 0.2]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (50, [1.0]), (100, [-1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = [tuple(r)[:3] for r in nearest_vectors(frame, vector_block=3, query_block=1).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 8), (0, 3, 7), (0, 4, 100), (100, 1, 7), (100, 2, 1), (100, 3, 8), (100, 4, 0)]
    assert nearest_vectors(frame.limit(0)).collect() == []


def test_network_gradient():
    rng = np.random.default_rng(1)
    net = lm.Network({n: v.astype(np.float64) for n, v in lm.fresh_parameters().items()})
    docs = [np.append(rng.integers(2, lm.CLASSES, n), lm.END).astype(np.uint8) for n in (7, 5, 9)]
    lanes, state = lm.Lanes.of(docs), np.zeros((3, lm.HIDDEN))

    def loss():
        chances = net.log_chances(net.states(lanes.inputs, lanes.starts, state).astype(np.float64), lanes.targets)
        return -(chances * lanes.valid.ravel()).sum() / lanes.valid.sum()

    slopes, _ = net.gradient(lanes.inputs, lanes.starts, lanes.targets, lanes.valid, state)
    for name, value in net.p.items():
        for _ in range(3):
            at = tuple(int(rng.integers(0, s)) for s in value.shape)
            at = (int(docs[0][2]), at[1]) if name == "inputs" else at
            here, value[at] = value[at], value[at] + 1e-2
            up = loss()
            value[at] = here - 1e-2
            assert abs((up - loss()) / 2e-2 - slopes[name][at]) < 1e-5
            value[at] = here


def test_language_scores_against_plain_counts(spark):
    rng = np.random.default_rng(3)
    vocabulary = words(rng, 60)
    texts = ["", None, "One\ttwo", "x" * 2000, *(" ".join(vocabulary[min(59, int(rng.exponential(12)))] for _ in range(int(rng.integers(1, 200)))) for _ in range(120))]
    ids = [*range(len(texts) - 1), None]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in zip(ids, texts)], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in lm.language_scores(frame).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for i, t in zip(ids, texts)}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in ids}
    counts = Counter(w for i in ids if not held[i] for w in tokens[i])
    total, kinds = sum(counts.values()), len(counts)
    for i, found in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(found), sum(counts[w] > 0 for w in found), total)
        assert abs(r.base_score - sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in found)) < 1e-6 * len(found)
        assert r.score < 0
    assert lm.language_scores(frame.limit(0)).collect() == []


def test_class_chances_sum_to_one():
    counts = np.array([1] * 30 + [2] * 10 + [5] * 4 + [400, 90])
    steps = np.zeros(200)
    for c in counts[counts > 1]:
        steps[int(lm.STEPS * np.log2(c))] += c
    above = np.cumsum(steps[::-1])[::-1] - steps / 2
    step_class = (2 + np.minimum((lm.CLASSES - 2) * above / steps.sum(), lm.CLASSES - 3)).astype(int)
    corpus = lm.Corpus(int(counts.sum()), len(counts), 3, step_class, np.bincount(step_class, weights=steps, minlength=lm.CLASSES), 30)
    classes, share, _ = corpus.tables(np.append(counts, 0))
    for k in set(classes.tolist()):
        assert abs((10 ** share[classes == k]).sum() - 1) < 1e-9


def test_network_learns_what_counts_cannot(spark):
    # a fixed cycle: a unigram model pays for each word, a recurrent one nearly nothing
    texts = [" ".join("abb"[(k + i) % 3] for k in range(1000)) for i in range(80)]
    got = lm.language_scores(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.1 * sum(r.base_score for r in got)


@pytest.fixture(scope="module")
def small_world(tmp_path_factory, spark):
    folder = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(12)
    docs, labels = toxic_rows(rng, 60)
    base = words(rng, 80)
    docs += [(500 + k, " ".join(base[:40] + [f"new{k}"] + base[40:]) + f"\nown line {words(rng, 6)}", "l", "s", 1) for k in range(4)]
    docs += [(600, "", "l", "s", 0), (601, None, "l", "s", 0), (602, "shared line of words here", "l", "s", 1), (603, "shared line of words here\nand more of it", "l", "s", 1)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, labels


def test_pipeline_against_plain_stages(spark, small_world, tmp_path):
    folder, docs, labels = small_world
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {i for i, _, t in labels if t}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in frame.collect()}
        out = stage(spark, frame, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert {r.doc_id for r in frame.collect()} == set(before)
            continue
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in frame.collect()}
        if name == "toxicity":
            assert set(after) == set(before) - toxic
        if name == "line_dedup":
            want = plain_lines([tuple(r) for r in before.values()])
            assert {i for i, n in Counter(d for (d, _), kept in want.items() if kept).items()} | {i for i, r in before.items() if not (r.text or "")} == set(after)
        if name == "near_dedup":
            sets = {i: plain_shingles(r.text) for i, r in before.items()}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            best = closure(sets, links)
            assert set(after) == {i for i in sets if best[i] == i}
    assert corpus_pipeline.run(spark, folder).count() == frame.count()
