import difflib
import random

from lodestone.operators import pages


def text(rng, n, signs="abcde  é日"):
    return "".join(rng.choices(signs, k=n))


def test_ratio_is_that_of_matching_blocks():
    rng = random.Random(3)
    for _ in range(300):
        a, b = text(rng, rng.randint(0, 60)), text(rng, rng.randint(0, 60))
        assert pages.ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_best_pages_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 7))) for _ in range(150)]
    new = lambda n: [rng.choice(words) for _ in range(n)]
    boiler = new(6)
    book = {i: " ".join(boiler + new(rng.randint(38, 44)) + boiler) for i in range(60)}
    book |= {100: book[7], 101: None, 102: "", 103: "one"}
    asked = {}
    for k in range(25):
        w = book[rng.randrange(60)].split()
        at = rng.randint(0, len(w) - 30)
        part = w[at : at + 30]
        part[rng.randrange(30)] = "changed"
        asked[k] = " ".join(part)
    asked |= {50: "nothing like any page of this book here", 51: None, 52: " ", 53: "one", 54: book[7]}
    best = {}
    for k, a in asked.items():
        scores = [(-difflib.SequenceMatcher(None, b, a, autojunk=False).ratio(), i) for i, b in book.items() if a and b]
        best[k] = min(scores)[1] if scores else None
    got = {r["passage_id"]: r["page_id"] for r in pages.best_pages(spark.createDataFrame(list(asked.items()), "passage_id long, text string"), spark.createDataFrame(list(book.items()), "page_id long, text string")).collect()}
    assert set(got) == set(asked) - {50, 51, 52} and got[54] == 7
    assert all(got[k] == best[k] for k in got)


def test_common_runs_give_no_candidates_where_rare_ones_do(spark):
    book = [(i, f"the same beginning of all pages and then number{i} of them ends here") for i in range(50)]
    asked = [(1, "the same beginning of all pages and then number31 of them")]
    found = pages.candidates(spark.createDataFrame(asked, "passage_id long, text string"), spark.createDataFrame(book, "page_id long, text string"), 3)
    assert [(r["passage_id"], r["page_id"]) for r in found.collect()] == [(1, 31)]
