import random

import pytest

from skein.llm import decontaminate as dc


def sellers(p, t):
    row, best = list(range(len(p) + 1)), (len(p), 0)
    for j, c in enumerate(t):
        last, row[0] = 0, 0
        for i, d in enumerate(p, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (c != d))
        best = min(best, (row[-1], j + 1))
    return best


def edited(r, text, n, letters):
    out = list(text)
    for _ in range(n):
        k = r.randrange(len(out) + 1)
        if r.random() < 0.4 or k == len(out):
            out.insert(k, r.choice(letters))
        elif r.random() < 0.5:
            out[k] = r.choice(letters)
        else:
            del out[k]
    return "".join(out)


def test_bit_parallel_distance_is_the_plain_one():
    r = random.Random(1)
    for _ in range(300):
        p = "".join(r.choices("abc ", k=r.randint(1, 80)))
        item = dc.Item(p, 0.2)
        t = "".join(r.choices("abc ", k=25)) + edited(r, p, r.randint(0, 8), "abcd") + "".join(r.choices("abc ", k=25))
        d, end = sellers(p, t)
        assert item.search(t, 0, len(t)) == ((d, end) if d <= item.budget else None)


@pytest.mark.parametrize("seed", [1, 2])
def test_finds_are_those_of_brute_force(seed):
    r = random.Random(seed)
    letters = "abcdefgh "
    say = lambda n: dc.normalise("".join(r.choices(letters, k=n)))
    items = {say(n): [n] for n in (13, 26, 40, 90, 200)}
    matcher = dc.Matcher(items)
    for _ in range(60):
        text = say(60) + " " + " ".join(edited(r, k, r.choice([0, 0, 1, 3, 9, 16]), letters) + " " + say(30) for k in items if r.random() < 0.4)
        norm = dc.normalise(text)
        want = {}
        for i, (item, _) in enumerate(matcher.items):
            d = sellers(item.text, norm)[0]
            if d <= item.budget:
                want[i] = d
        assert {i: d for i, (d, _) in matcher.matches(text).items()} == want


def test_documents_and_items_of_all_kinds(spark):
    item = "The quick brown fox jumps over the lazy dog near the old river bank, twice a day."
    near = item.replace("quick", "quikc").upper().replace(" ", "\n")
    docs = [(1, f"Before. {item} After.", "i"), (2, f"x {near} y", "i"), (3, "nothing here", "i"), (4, None, "i"), (5, "", "i"), (6, "w " * 100_000 + item, "i"), (7, f"{item} {item}", "i"), (7, f"{item} {item}", "i"), (None, item, "i"), (8, "a yes b", "i"), (9, "yesterday", "i")]
    tests = [(10, item, "d"), (11, item, "d"), (12, None, "d"), (13, "--", "d"), (14, "yes", "d"), (15, "another test item that is in no document at all", "d")]
    documents, benchmark = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3), spark.createDataFrame(tests, "item_id long, text string, doc_id string")
    for size in (2_000_000, 60):  # one block of items, and several
        got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in dc.find_contamination(documents, benchmark, block_chars=size).collect()), key=str)
        want = sorted([(d, i, 2 if d == 2 else 0) for d in (1, 2, 6, 7, 7, None) for i in (10, 11)] + [(8, 14, 0)], key=str)
        assert got == want
        kept = dc.drop_contaminated(documents, benchmark, block_chars=size)
        assert kept.columns == documents.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 9]
    assert dc.find_contamination(documents.limit(0), benchmark).count() == 0
    assert dc.find_contamination(documents, benchmark.limit(0)).count() == 0 and dc.drop_contaminated(documents, benchmark.limit(0)).count() == len(docs)
