"""Mixing, quality, near-duplicates, neighbours, toxicity and the pipeline against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from introna.llm import components, minhash, mixing, neighbours, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", words string, size long, place string, row string, component_id long, kept string, vote_upper string, x string"


def frame(spark, rows, extra=False):
    more = ("w", 7, "p", "r", 9, "k", "v", "x") if extra else ()
    return spark.createDataFrame([(*r, *more) for r in rows], EXTRA if extra else DOCS).repartition(3)


def random_docs(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 120))) for _ in range(n // 3)]
    for t in list(texts):
        part = t.split(" ")
        for _ in range(rng.randint(1, 4)):
            part[rng.randrange(len(part))] = rng.choice(words)
        texts += [" ".join(part), t] if rng.random() < 0.7 else [t.upper()]
    texts += [None, "", " \n", "one", "one", "one two", "w1 " * 30]
    return [(i, t, "en", rng.choice(["a", "b", "c", "é", None]), None) for i, t in enumerate(texts)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# mixing

def plain_mix(rows, cycle=(3, 1, 2), share=1.5, epochs=2.0):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, clamped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in clamped)
        open_ = [s for s in order if s not in clamped]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not over:
            return sizes, {s: epochs * sizes[s] if s in clamped else level * weight[s] for s in order}
        clamped |= over


def test_mix_meets_its_targets(spark):
    rows = random_docs()
    sizes, targets = plain_mix(rows)
    got = mixing.mix_plan(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.size == len(words_of(rows[r.doc_id][1])) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s]
    again = mixing.mix_plan(frame(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_repeats_rows(spark, monkeypatch):
    rows = random_docs(2)
    rows += rows[:5]  # repeated rows count one by one
    plan = Counter()
    for r in mixing.mix_plan(frame(spark, rows)).collect():
        plan[r.doc_id] += r.copies
    for limit in (mixing.SMALL_SOURCES, -1):
        monkeypatch.setattr(mixing, "SMALL_SOURCES", limit)
        out = mixing.mix(frame(spark, rows, extra=True))
        assert out.columns == EXTRA_COLUMNS
        assert Counter(r.doc_id for r in out.collect()) == +plan


EXTRA_COLUMNS = [c.split()[0] for c in EXTRA.split(", ")]


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    rows = [(1, None, "en", "a", None), (2, "", "en", None, None)]
    got = mixing.mix_plan(frame(spark, rows)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


# quality

def plain_counts(text):
    words, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) for d in range(3) if windows[tuple(words[i : i + 3])] > 1}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_quality_counts_and_verdicts(spark):
    rows = random_docs(3, 150)
    junk = [f"Ab{i}%%% " * 40 + " ".join(f"q{i}x{j}###" for j in range(60)) for i in range(12)]
    junk += [" ".join(f"LOUD{i}X{j}!!" for j in range(70)) for i in range(12)]
    rows += [(1000 + i, t, "en", "j", None) for i, t in enumerate([*junk, "a b c d\na b c d\nx\nx y z a b c", "a  b c a b c a b"])]
    rows = [r for r in rows if not (r[1] or "").isupper() or r[0] >= 1000]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows, extra=True)).collect()}
    for i, text, *_ in rows:
        r, want = got[i], plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
        if not r.base_failed:
            assert r.kept == (i < 1000), (i, text)
    kept = quality.keep_good(frame(spark, rows, extra=True))
    assert kept.columns == EXTRA_COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].kept)
    assert quality.judge(frame(spark, [])).count() == 0


# near-duplicates

def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def plain_classes(rows, width):
    sets = {}
    for i, text, *_ in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
        n = max(1, len(words) - width + 1)
        sets[i] = {tuple(words[j : j + width]) for j in range(n)} if words else set()
    ids = list(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[:k]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return sets, plain_components(links, ids)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rows = random_docs(4, 90)
    sets, want = plain_classes(rows, width)
    got = minhash.classes(frame(spark, rows, extra=True), width, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert len(set(want.values())) < len(rows) - 10


def test_near_copies_at_the_threshold(spark, monkeypatch):
    """Copies of one text on both sides of the threshold, in blocks smaller than the group."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 10)):
            words[at] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(words), "en", "s", None))
    _, want = plain_classes(rows, 2)
    got = {r.doc_id: r.component_id for r in minhash.classes(frame(spark, rows), 2, 80).collect()}
    # every text of a class is found; banding may miss a pair at the very threshold once in ten thousand
    assert got == want and 1 < len(set(want.values())) < 70


def test_drop_near_duplicates(spark, monkeypatch):
    rows = random_docs(6, 60)
    rows += [rows[0], (None, "text without id " * 20, "en", "s", None), (None, None, "en", None, None)]
    _, want = plain_classes([r for r in rows if r[0] is not None], 5)
    for limit in (minhash.BROADCAST_IDS, -1):
        monkeypatch.setattr(minhash, "BROADCAST_IDS", limit)
        kept = minhash.drop_near_duplicates(frame(spark, rows, extra=True))
        assert kept.columns == EXTRA_COLUMNS
        ids = Counter(r.doc_id for r in kept.collect())
        assert ids.pop(None) == 2 and ids == Counter(i for i in want if want[i] == i)
    assert minhash.classes(frame(spark, [])).count() == 0


def test_rows_of_one_id_stand_for_their_own_texts(spark):
    a, q, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "aqz")
    rows = [(1, a), (1, q), (2, a), (3, q), (1, ""), (1, " "), (4, z), (4, z), (4, z + " more"), (5, z + " more")]
    docs = frame(spark, [(i, t, "en", "s", None) for i, t in rows])
    found = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.classes(docs).collect())
    assert found == Counter({(1, 1, True): 4, (2, 1, False): 1, (3, 1, False): 1, (4, 4, True): 3, (5, 4, False): 1})
    left = Counter((r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs).collect())
    assert left[1, a] == left[1, q] == left[1, ""] == left[1, " "] == left[4, z] == 1
    assert not {i for i, _ in left} - {1, 4}


def test_large_sets_meet_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1 << 16)
    base = [f"w{i}" for i in range(200_000)]
    near = [*base[:60_000], "x", *base[60_001:]]
    rows = [(7, " ".join(base)), (3, " ".join(near)), (9, " ".join(base[:100_000]))]
    docs = frame(spark, [(i, t, "en", "s", None) for i, t in rows])
    assert {r.doc_id: r.component_id for r in minhash.classes(docs).collect()} == {7: 3, 3: 3, 9: 9}


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (7, None)]
    rng.shuffle(edges)
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = plain_components(real, {n for e in real for n in e})
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# neighbours

VECTORS = "vec_id long, embedding array<float>, label int, tile long, side int, score double"


def plain_nearest(rows, k):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound.setdefault(i, np.array(v, np.float32).astype(float))
    out = {}
    for q in (i for i in sound if i % 20 == 0):
        scored = []
        for i, v in sound.items():
            if i != q and len(v) == len(sound[q]):
                total = 0.0
                for a, b in zip(sound[q], v):
                    total += a * b
                scored.append((-total, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 8)
    monkeypatch.setattr(neighbours, "STEP", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[40][1]) for i in range(300, 360)]  # one vector very often
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] * 12), (404, [1.0, None] * 6), (405, [float("inf")] * 12), (None, [1.0] * 12)]
    rows += [(420, [1.0, 2.0]), (421, [3.0, 4.0]), (3, rows[3][1])]
    got = defaultdict(list)
    data = spark.createDataFrame([(*r, 1, 2, 3, 4.0) for r in rows], VECTORS).repartition(3)
    for r in neighbours.nearest(data, data["vec_id"] % 20 == 0, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = {q: v for q, v in plain_nearest(rows, 7).items() if v}
    assert dict(got) == want
    none = spark.createDataFrame([], VECTORS)
    assert neighbours.nearest(none, none["vec_id"] % 20 == 0, 7).count() == 0


def test_repeated_ids_are_their_smallest_vector(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    twice = [(i, (np.array(v) + d).tolist()) for i, v in rows[::5] for d in (-0.5, 0.5)]
    least = {i: min([v, *(w for j, w in twice if j == i)]) for i, v in rows}
    frame_of = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>").repartition(5)
    got, want = (
        sorted(tuple(r) for r in neighbours.nearest(df, df["vec_id"] % 20 == 0, 5).collect()) for df in (frame_of(rows + twice), frame_of(list(least.items())))
    )
    assert got == want and len(got) == 15


def test_bounds_of_int8_products():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 30)) * rng.uniform(0.01, 100, (50, 1)), rng.normal(size=(60, 30))
    qa, sa, ka, ma = neighbours.quantised(a)
    qb, sb, kb, mb = neighbours.quantised(b)
    about = neighbours.products(qa, qb) * np.outer(sa, sb)
    assert (np.abs(about - a @ b.T) <= np.outer(ma, np.linalg.norm(b, axis=1)) + np.outer(ka, mb) + 1e-9).all()


# toxicity

def toxic_tables(spark, n=900):
    rng = random.Random(8)
    usual, bad = [f"{a}{b}" for a in ("the", "sto", "rin", "bel", "cam") for b in "abcdefghij"], ["vilest", "vilely", "scummy", "scumbag"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = [rng.choice(usual) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "s", None))
        labels.append((i, 1, int(toxic)))
    rows += [(n, None, "en", None, None), (n + 1, "", "en", None, None), (None, "who", "en", None, None), (n + 2, "vile scumming word", "en", "s", None)]
    return frame(spark, rows), spark.createDataFrame([*labels, (n + 9, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark):
    import zlib

    docs, labels, known = toxic_tables(spark)
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {i: t for i, _, t in known}
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_held_out_labels_are_not_used(spark):
    import zlib

    docs, labels, known = toxic_tables(spark, 300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in known]
    other = spark.createDataFrame(turned, "doc_id long, quality int, toxic int")
    a, b = ({(r.doc_id, r.score) for r in toxicity.score(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_toxicity_sample_fills_its_bounds(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 6400)
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 40)
    texts = [(i, "word " * 4, "en", "s", None) for i in range(600)]
    huge = [(1000 + i, "huge " * 5000, "en", "s", None) for i in range(9)]
    copies = [(2000 + i % 3, "copy", "en", "s", None) for i in range(300)]
    labels = spark.createDataFrame([(r[0], 1, int(r[0] % 2)) for r in texts + huge + copies[:3]], "doc_id long, quality int, toxic int")
    rows = toxicity.labelled(frame(spark, [*texts, *huge, *copies]), labels).collect()
    for toxic in (0, 1):
        own = [r for r in rows if r.toxic == toxic]
        assert len(own) == len({r.doc_id for r in own}) == 40 and max(len(r.text) for r in own) <= 100
    # more documents in a class than one stretch may hold, all in the same stretch
    monkeypatch.setattr(toxicity, "hashed", lambda seed, *c: c[0].cast("long"))
    assert Counter(r.toxic for r in toxicity.labelled(frame(spark, texts), labels).collect()) == {0: 40, 1: 40}
    # where all fit, all are taken whole
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 1 << 20)
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 1000)
    rows = toxicity.labelled(frame(spark, [*texts, *huge]), labels).collect()
    assert {len(r.text) for r in rows} == {20, 25000} and {r.weight for r in rows} == {1.0}


def test_toxicity_without_labels(spark):
    docs = frame(spark, random_docs(9, 12))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(frame(spark, []), none).count() == 0


# pipeline

def test_pipeline_equals_its_parts(spark, tmp_path):
    """The stages one by one in plain Python: base rules, classes, mail surrogates, mix, ids."""
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline
    from introna.llm import surrogates
    from introna.llm.queries import tokenizer_path

    rows = random_docs(10, 75)
    rows = [(i, t if i % 7 or not t else f"{t} me{i}@mail.example.com", l, s, len(t or "")) for i, t, l, s, _ in rows if not (t or "").isupper()]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r for r in rows if plain_counts(r[1])[0] >= 50 and 2 * plain_counts(r[1])[4] <= plain_counts(r[1])[0]]
    _, classes = plain_classes(kept, 5)
    kept = [r for r in kept if classes[r[0]] == r[0]]
    texts = {r[0]: surrogates._rewrite(r[1], surrogates.KEY, {})[0] for r in kept}
    assert not any("@mail.example.com" in t for t in texts.values())
    sizes, targets = plain_mix([(r[0], texts[r[0]], *r[2:]) for r in kept])
    copies, taken = {}, Counter()
    by = defaultdict(list)
    for r in kept:
        place = int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:15], 16)
        by[r[3]].append((place, r[0], len(words_of(texts[r[0]]))))
    for source, own in by.items():
        whole = int(targets[source] // sizes[source])
        extra, running = targets[source] - whole * sizes[source], 0
        for _, i, size in sorted(own):
            running += size
            copies[i] = whole + (2 * running - size <= 2 * extra)
            taken[source] += copies[i] * size
    assert Counter(r.doc_id for r in out) == +Counter(copies)
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    for r in out:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and r.n_chars == len(texts[r.doc_id])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "encoding"]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
