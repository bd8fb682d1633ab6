import random

import pytest

from careflow.llm import jaccard
from careflow.llm.components import components
from careflow.llm.jaccard import near_duplicates, one_of_each, similar_pairs


def texts(seed, n):
    """Random texts with copies, near copies, chains of edits and shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(30)]
    out = [None, "", " \t\n", "one", "one", "One two", "one two three four five", "x " * 300]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.35 or len(out) < 15:
            text = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 8, 12, 25, 60, 150]))]
        else:
            text = (rng.choice(out) or "a b c d e f").split()
            for _ in range(rng.choice([0, 1, 1, 2, 3]) if kind < 0.85 else 0):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
        if kind > 0.93:
            text = text + shared
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed, most, rounds", [(1, None, 4), (2, 0, 4), (3, None, 0)])
def test_equals_sql(docs, against_sql, monkeypatch, seed, most, rounds):
    monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", rounds)
    against_sql("op4_jaccard_join", lambda documents: near_duplicates(documents, most_bytes=most), documents=docs(*texts(seed, 160)))


def test_every_link_is_found(docs):
    table = texts(4, 120)
    links, members = similar_pairs(docs(*table))

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for t in table]
    classes = {r.cls: sets[r.doc_id] for r in members.collect() if r.cls is not None}
    got = {(r.a, r.b) for r in links.collect()}
    want = {(a, b) for a in classes for b in classes if a < b and 100 * len(classes[a] & classes[b]) >= 80 * len(classes[a] | classes[b])}
    assert got == want and want


@pytest.mark.parametrize("percent", [75, 60, 51])
def test_small_sets_are_linked_at_lower_percentages(docs, percent):
    rng = random.Random(percent)
    sets = [frozenset(rng.sample("abcdefg", rng.randint(1, 5))) for _ in range(90)]
    links, members = similar_pairs(docs(*[" ".join(sorted(s)) for s in sets]), shingle=1, percent=percent)
    classes = {r.cls: sets[r.doc_id] for r in members.collect()}
    got = {(r.a, r.b) for r in links.collect()}
    want = {(a, b) for a in classes for b in classes if a < b and 100 * len(classes[a] & classes[b]) >= percent * len(classes[a] | classes[b])}
    assert got == want and any(len(classes[a]) <= 3 for a, _ in want)


@pytest.mark.parametrize("percent", [0, 50, 101])
def test_percentages_that_two_common_tokens_do_not_cover_are_refused(docs, percent):
    with pytest.raises(ValueError, match="percent"):
        similar_pairs(docs("a b c"), percent=percent)


def test_a_group_of_near_copies_is_not_compared_pair_by_pair(docs):
    base = [f"w{i}" for i in range(100)]
    near = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(60)]
    out = near_duplicates(docs(" ".join(base), *near))
    assert {r.component_id for r in out.collect()} == {0}


def edited_group(seed, n, length, edits):
    """Texts made from one by random edits: each is near the source, pairs are about the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(edits):
            text[rng.randrange(length)] = f"new{rng.randrange(40)}"
        out.append(" ".join(text))
    return out


def test_a_group_about_the_threshold_equals_sql(docs, against_sql, monkeypatch):
    """Many pairs of the group are below the threshold, so pivots leave several components open."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 50)
    monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", 1)
    blocks, plain = [], jaccard.Join.in_blocks
    monkeypatch.setattr(jaccard.Join, "in_blocks", lambda *a: blocks.append(plain(*a)) or blocks[-1])
    table = edited_group(1, 220, 92, 1) + texts(5, 60)
    against_sql("op4_jaccard_join", lambda documents: near_duplicates(documents), documents=docs(*table))
    assert blocks[0][0].count() > 0


def test_every_link_of_a_group_is_found(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 40)
    table = edited_group(2, 150, 92, 1)
    links, members = similar_pairs(docs(*table))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(88)} for t in table]
    cls = {r.doc_id: r.cls for r in members.collect()}
    want = {
        (min(cls[i], cls[j]), max(cls[i], cls[j]))
        for i in range(150) for j in range(i) if cls[i] != cls[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    }
    got = [(r.a, r.b) for r in links.collect()]
    assert set(got) == want and len(got) == len(want) and 300 < len(want) < 150 * 149 // 2


def test_one_of_each_keeps_all_columns(docs):
    table = docs((5, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (None, "A b c d e f g h"), (None, "q r s t u v"), (9, None), (9, None), (8, ""))
    kept = one_of_each(table)
    assert kept.columns == table.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        [("3", "a b c d e f g h"), ("None", "q r s t u v"), ("9", "None"), ("9", "None"), ("8", "")]
    )
    assert one_of_each(table.limit(0)).count() == near_duplicates(table.limit(0)).count() == 0


def test_null_ids(docs):
    got = near_duplicates(docs((None, "a b c d e f"), (4, "a b c d e f"), (None, "z z z z z z z"), (None, None))).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == ["(4, 4)", "(None, 4)", "(None, None)", "(None, None)"]


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(1, i) for i in range(2, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 1 for i in range(1, 30))
