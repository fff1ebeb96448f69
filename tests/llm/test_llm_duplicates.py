import random

import numpy as np
import pytest

from vacatlas.llm import decontaminate, neardup, substrings, vectors
from vacatlas.llm.components import components
from vacatlas.llm.words import folded


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (3, 2), (3, 2)]
    links += [(rng.randint(1000, 1040), rng.randint(1000, 1040)) for _ in range(25)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {(r.id, r.root) for r in components(df).collect()} == {(x, find(x)) for x in root}
    assert components(df.limit(0)).count() == 0


def variants(seed=0):
    """Copies and near copies in groups, a passage that most texts share, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.6:
                own += passage
            out.append(" ".join(own))
    return [*out, *out[:3], "", None, " \n", "One two", "one TWO", "x", "passage " * 500]


def brute_near(rows, width, share):
    sets = {}
    for key, text in rows:
        words = folded(text)
        sets[key] = {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if share[1] * shared >= share[0] * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {(k, len(s), find(k), find(k) == k) for k, s in sets.items()}


@pytest.mark.parametrize("width, share, short", [(3, (85, 100), 64), (5, (4, 5), 64), (3, (85, 100), 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, share, short):
    monkeypatch.setattr(neardup, "SHORT_LIST", short)  # so that long lists and blocks are met, too
    monkeypatch.setattr(neardup, "BLOCK", 5 if short == 4 else 1024)
    rows = list(enumerate(variants()))
    df = spark.createDataFrame([(k, t, 1, "q") for k, t in rows], "doc_id bigint, text string, n int, cid string")
    found = neardup.near_duplicates(df, width, share).collect()
    assert {tuple(r) for r in found} == brute_near(rows, width, share) and len(found) == len(rows)


@pytest.mark.parametrize("short", [64, 1])
def test_near_duplicates_of_one_id_on_several_texts(spark, monkeypatch, short):
    monkeypatch.setattr(neardup, "SHORT_LIST", short)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    texts = [t for t in variants() if t and t.split()]
    rows = [(i * 7 % 23, t) for i, t in enumerate(texts)]
    sets = [frozenset(tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))) for w in (folded(t) for t in texts)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 85 * len(x | y):
                root[find(i)] = find(j)
    first: dict = {}
    for i, (key, _) in enumerate(rows):
        first[find(i)] = min(key, first.get(find(i), key))
    want = sorted((k, len(sets[i]), first[find(i)], k == first[find(i)]) for i, (k, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, neardup.near_duplicates(df, 3, (85, 100)).collect())) == want


def test_near_duplicates_of_edge_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (None, "no id of its own"), (2, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(neardup.near_duplicates(df, 3, (85, 100)).collect(), key=str)
    assert sorted(map(tuple, found), key=str) == sorted([
        (1, 4, 1, True), (1, 4, 1, True), (None, 4, 1, False), (None, 3, None, False), (2, 0, 2, True), (None, 0, None, False),
    ], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    kept = neardup.keep_one(df.union(spark.createDataFrame([(3, "a b c d e f")], df.schema)))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "None", "None", "None"]


def brute_cut(texts, size):
    words = [(t or "").encode().split() for t in texts]
    seen: dict = {}
    for own in words:
        for i in range(len(own) - size + 1):
            key = tuple(own[i:i + size])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for own in words:
        gone = [False] * len(own)
        for i in range(len(own) - size + 1):
            if seen[tuple(own[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append((len(own), sum(gone), b" ".join(w for w, g in zip(own, gone, strict=True) if not g).decode()))
    return out


def passages(seed):
    """Few words, so that much repeats: passages, runs, periods, whole copies, and texts around a window's length."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 400]))]
    parts = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] for _ in range(8)]
    parts += [["a"] * 40, ["a", "b"] * 25, ["x", "y", "z"] * 14]
    out = []
    for _ in range(40):
        own = [w for _ in range(rng.randint(0, 4)) for w in (rng.choice(parts) if rng.random() < 0.6 else [rng.choice(vocabulary)])]
        out.append(rng.choice([" ", "\n", " \t "]).join(own))
    return [*out, *out[:3], None, "", "  "]


@pytest.mark.parametrize("size, seed", [(7, 0), (12, 1), (35, 2), (35, 3)])
def test_substrings_equal_brute_force(spark, size, seed):
    items = passages(seed)
    df = spark.createDataFrame([(i, t, "keep", 1) for i, t in enumerate(items)], "doc_id bigint, text string, lang string, n_words int")
    found = substrings.remove_repeats(df, size, carry=("lang",)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.text) for r in found] == brute_cut(items, size)
    assert {r.lang for r in found} == {"keep"}


def test_substrings_of_edge_cases(spark):
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, text), (1, text), (None, "a  b"), (None, None)], "doc_id bigint, text string")
    found = sorted(map(tuple, substrings.remove_repeats(df).collect()), key=str)
    assert found == sorted([(1, "", 50, 50), (1, "", 50, 50), (None, "a b", 2, 0), (None, "", 0, 0)], key=str)
    assert substrings.remove_repeats(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "7 as N_Words", "8 as id")
    assert {(r.N_Words, r.id) for r in substrings.remove_repeats(clash, carry=("N_Words", "id")).collect()} == {(7, 8)}


def test_symbols_inside_equal_windows_are_equal():
    rng = np.random.default_rng(5)
    window = rng.integers(0, 30, 40).astype(np.uint64)
    found = []
    for _ in range(30):
        left, right = (rng.integers(0, 30, rng.integers(0, 50)).astype(np.uint64) for _ in range(2))
        words = np.concatenate([left, window, right])
        parse = substrings.Parse(words, np.zeros(len(words), int), 35)
        sym, s, e, near, far = parse.low
        inside = (near >= len(left)) & (far <= len(left) + 40)
        found.append({(int(a), int(b) - len(left), int(c) - len(left)) for a, b, c in zip(sym[inside], s[inside], e[inside], strict=True)})
    assert all(x == found[0] for x in found) and found[0]


def brute_vectors(rows, cosine):
    good = {}
    for i, (_, vec, label) in enumerate(rows):
        x = np.array(vec if vec and None not in vec else [np.nan], float)
        if label is not None and np.isfinite(x).all() and x.any():
            good[i] = label, x / np.linalg.norm(x)
    near = {i: {j for j, (m, y) in good.items() if j != i and m == l and len(x) == len(y) and x @ y >= cosine} for i, (l, x) in good.items()}
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min(rows[j][0] for j in seen)
        out.append((key, len(near.get(i, ())), root, root == key))
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors.vector_links, "__defaults__", (block,))
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        base = rng.standard_normal(16) if i % 6 == 0 else base + rng.standard_normal(16) * rng.choice([0.0, 0.03, 0.1])
        rows.append((i, base.tolist(), i % 2 if i < 100 else 7))
    rows += [
        (200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] + [0.0] * 15, 1),
        (204, [], 1), (205, rows[0][1], None), (206, [None] * 16, 1), (207, [1e200] * 16, 1), (208, [1e-200] * 16, 1), (209, [1.0] * 3, 1),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id bigint, embedding array<double>, label int, cid string")
    found = sorted(map(tuple, vectors.near_vectors(df).collect()))
    with np.errstate(over="ignore"):
        want = brute_vectors([(k, [x / 1e200 for x in v] if k == 207 else [x * 1e200 for x in v] if k == 208 else v, m) for k, v, m in rows], 0.98)
    assert found == sorted(want)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_contamination(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(40)] + [(90, None), (91, ""), (None, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for i in range(60):
        part = rng.choice(items)[1] or ""
        own = part.split()
        for _ in range(rng.randint(0, 2)):
            if own:
                own[rng.randrange(len(own))] = "changed"
        docs.append((i, " ".join([*rng.choices(words, k=rng.randint(0, 300)), *own, "end"]).upper(), 1))
    docs += [(70, None, 1), (71, "", 1), (None, "w1 w2 w3 w4 w5 w6 w7", 1), (None, "w1 w2 w3 w4 w5 w6 w7", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for key, text, _ in docs:
        own = folded(text)
        for item, part in items:
            p = folded(part)
            w = min(5, len(p))
            if w:
                need = {tuple(p[i:i + w]) for i in range(len(p) - w + 1)}
                n = len(need & {tuple(own[i:i + w]) for i in range(len(own) - w + 1)})
                if n >= 0.8 * len(need):
                    want.append((key, item, len(need), n, n / len(need)))
    found = decontaminate.contaminated(df, bench)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str) and want
    clean = {k for k, _, _ in docs} - {x[0] for x in want}
    assert {r.doc_id for r in decontaminate.remove_contaminated(df, bench).collect()} == clean
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 == decontaminate.contaminated(df.limit(0), bench).count()


def test_items_joined_instead_of_broadcast(spark):
    texts = [f"q{i} a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(9)]
    items = spark.createDataFrame([*enumerate(texts), (50, texts[3].upper())], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"x y {t} z") for i, t in enumerate(texts * 2)], "doc_id bigint, text string")
    found = [sorted(map(tuple, decontaminate.contaminated(docs, items, broadcast_bytes=n).collect())) for n in (0, 1 << 20)]
    assert found[0] == found[1] and len(found[0]) == 20
    assert decontaminate.remove_contaminated(docs, items, broadcast_bytes=0).count() == 0
    assert decontaminate.least_hits(10, 0.8) == 8 and 1 <= decontaminate.least_hits(500, 0.8) < 16


def test_values_that_many_items_hold_are_left_unasked(spark):
    shared = " ".join(f"s{j}" for j in range(20))
    rows = [(i, f"{shared} {' '.join(f'u{i}x{j}' for j in range(20))}") for i in range(30)]
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    table = decontaminate.item_table(items, 5, 0.8, "item_id", "text")
    whole, rare = (decontaminate.kept_values(table, n).collect() for n in (100, 3))
    assert len(rare) < len(whole) and {r.item for r in rare} == {r.item for r in whole}
    assert all(r.needed >= 1 for r in rare) and min(r.needed for r in rare) < min(r.needed for r in whole)


def test_decontamination_of_odd_tables(spark):
    item = "one two three four five six seven"
    items = spark.createDataFrame([(1, item, "x"), (1, item, "y")], "item_id int, text string, row string")
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    rows = [("a", None, 1.5), ("b", "", None), ("c", f"{long} {item} {long}", 2.0), ("c", f"{long} {item} {long}", 2.0), ("d", long, 0.0)]
    docs = spark.createDataFrame(rows, "values string, body string, row double")
    kept = decontaminate.remove_contaminated(docs, items, text_col="body")
    assert kept.schema == docs.schema and sorted(r["values"] for r in kept.collect()) == ["a", "b", "d"]
    found = decontaminate.contaminated(docs, items, id_col="row", text_col="body").collect()
    assert [(r.doc_id, r.item_id, r.n_shared) for r in found] == [(2, 1, 3)] * 4
    only = decontaminate.remove_contaminated(docs.select("body"), items, text_col="body")
    assert only.columns == ["body"] and only.count() == 3


def test_filter_of_values(spark):
    values = spark.range(5000).selectExpr("xxhash64(id) AS value")
    for most in (1 << 27, 1 << 12):
        words = decontaminate.value_filter(values, most)
        assert len(words) * 64 <= most
        own = np.array([r.value for r in values.collect()], np.int64).view(np.uint64)
        assert len(decontaminate.held(own, words)) == 5000
    words = decontaminate.value_filter(values)
    assert len(decontaminate.held(np.random.default_rng(0).integers(0, 1 << 63, 100_000, dtype=np.uint64), words)) < 20
