import pathlib
import random
import textwrap
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import lang_id, license_scan, line_dedup, mixing, quality_rules

from ..conftest import SMALL, same_rows
from .fixtures import awkward, empty

WS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def repeated(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(covered)


def test_rules_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(["a", "b", "#", " ", " ", "\n", "\x0b", "é", "*"], k=rng.randint(0, 200))), f"h{i % 3}") for i in range(80)]
    docs = spark.createDataFrame(rows + [(100, None, None), (101, "x " * 30_000, "h1")], "doc_id long, text string, source string")
    for r in quality_rules.measures(docs).collect():
        text = next((t for i, t, _ in rows if i == r["doc_id"]), None if r["doc_id"] == 100 else "x " * 30_000)
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(len(x.decode()) for x in w))
        assert r["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(text)
        assert r["base_failed"] == (len(w) < 10 or 100 * repeated(text) > 20 * len(w))


GOOD = "all these {0} words differ from one another and so nothing here repeats itself"
FAILS = {"few_words": "short {0}", "repeats": "a b c d e {0} " + "v w x y z " * 6, "symbols": "the $$$ ### *** {0} price of all that one may want to have is %%% here", "dup_lines": "one line {0}\nanother line of words\none line {0}\nthe last of them all\none line {0}"}


def host_rows():
    """Hosts of which one in twenty documents fails a rule, hosts of which most do, one of two documents and a null one."""
    rows = []
    for h in range(12):
        rows += [(f"fine{h}", (list(FAILS.values())[i % 4] if i % 20 == 0 else GOOD).format(i)) for i in range(60)]
    for rule, text in FAILS.items():
        rows += [(f"bad-{rule}", (GOOD if i % 5 == 0 else text).format(i)) for i in range(40)]
    rows += [("tiny", FAILS["symbols"].format(1)), ("tiny", GOOD.format(2)), (None, GOOD.format(1)), (None, FAILS["dup_lines"].format(1))]
    return [(i, text, host) for i, (host, text) in enumerate(rows)]


def test_hosts_with_many_failures_go(spark):
    import duckdb

    rows = host_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    fallen = {h for i, _, h in rows if got[i]["host_failed"]}
    assert fallen == {f"bad-{r}" for r in FAILS}
    decided = [i for i, _, h in rows if not got[i]["base_failed"] and not got[i]["kept"]]
    assert len(decided) > 60 and {h for i, _, h in rows if i in set(decided)} == fallen
    assert got[len(rows) - 4]["kept"] and got[len(rows) - 2]["kept"] and got[len(rows) - 1]["kept"]
    assert 0.1 < got[len(rows) - 4]["host_rate"] < 0.9  # one failure of two: shrunk
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert same_rows(quality_rules.judge(docs).select("doc_id", *quality_rules.OUT), con, quality_rules.SQL) == len(rows)


def test_hosts_that_are_alike_stay(spark):
    rows = [(i, FAILS["symbols"].format(i) if i % 4 == 0 else GOOD.format(i), f"h{i % 7}") for i in range(140)]
    assert all(r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_priors():
    assert quality_rules.beta_prior(None, 0, 0, 0, 0) == quality_rules.beta_prior(9, 2, 50, 9, 0) == (1.0, 1.0)
    a, b = quality_rules.beta_prior(100.0, 4, 4 * 625.0, 20, 0.0)  # no more than chance: as strong as all documents
    assert (a, b) == (pytest.approx(20), pytest.approx(80))
    rng = random.Random(4)
    hosts = [(n, sum(rng.random() < p for _ in range(n))) for n, p in ((rng.randint(20, 400), rng.betavariate(3, 12)) for _ in range(400))]
    n, k = sum(x for x, _ in hosts), sum(x for _, x in hosts)
    a, b = quality_rules.beta_prior(n, len(hosts), sum(x * x for x, _ in hosts), k, sum(x * (y / x - k / n) ** 2 for x, y in hosts))
    assert 2 < a < 4.5 and 8 < b < 18


def test_rules_of_awkward_rows(spark):
    assert quality_rules.judge(empty(spark)).count() == 0
    docs = awkward(spark, extra=True)
    out = quality_rules.judge(docs)
    assert out.count() == docs.count() and {"score", "hash"} <= set(out.columns)
    assert {r["doc_id"]: r["kept"] for r in out.collect()}[3] is False
    assert out.where("n_chars is not null").select("score").distinct().first()[0] == "clash"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) > 40")
    out = lang_id.predict(docs.withColumn("score", F.lit("clash")), lang_id.learnt(docs)).withColumn("held", lang_id.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["rejected"] for r in out) <= 0.02 * len(out)


def test_languages_against_brute_force(spark):
    """A plain loop over the same dictionaries: sizes of blocks, the smallest sum, the score."""
    import zstandard as z

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = lang_id.learnt(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1, None), (-2, "½ ² Ⅷ 12!"), (-3, "ª"), (-4, "日本"), (-5, "x" * 40_000), (-6, "")]
    got = {r["doc_id"]: r for r in lang_id.predict(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), known, names=("a", "b", "c")).collect()}
    for i, text in rows:
        if text is None or not any(unicodedata.category(x)[0] == "L" for x in text):
            assert tuple(got[i][c] for c in "abc") == ("und", 0.0, True), i
            continue
        raw, sizes = text.lower().encode(), {}
        n = -(-len(raw) // lang_id.BLOCK)
        for lang, content in known.items():
            box = z.ZstdCompressor(level=lang_id.LEVEL, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(box.compress(raw[len(raw) * k // n : len(raw) * (k + 1) // n])) for k in range(n))
        best, second = sorted(sizes.values())[:2]
        score = (second - best) / second
        assert sizes[got[i]["a"]] == best and got[i]["b"] == pytest.approx(score) and got[i]["c"] == (score < lang_id.MIN_SCORE), i


def test_long_clean_texts_are_not_rejected(spark):
    rng = random.Random(12)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) > 40 and lang is not null")
    said = {}
    for r in docs.where(lang_id.held_out(F.col("doc_id"))).orderBy("doc_id").collect():
        said.setdefault(r["lang"], []).extend(r["text"].split(" "))
    rows = []
    for lang, pool in sorted(said.items()):
        text = " ".join(rng.choices(pool, k=3_000_000))
        rows += [(lang, n, text[:n]) for n in (15_000, 20_000, 1_000_000, 12_000_000)]
        assert len(text) > 12_000_000
    texts = spark.createDataFrame(rows, "lang string, size long, text string").repartition(8)
    out = lang_id.predict(texts, lang_id.learnt(docs)).drop("text").collect()
    print(sorted((r["lang"], r["size"], r["lang_pred"], round(r["score"], 5), r["rejected"]) for r in out))
    assert len(out) == 16 and all(r["lang"] == r["lang_pred"] and not r["rejected"] for r in out)
    for lang in said:
        scores = [r["score"] for r in out if r["lang"] == lang]
        assert min(scores) > 0.5 * max(scores)


def test_languages_of_awkward_rows(spark):
    docs = awkward(spark, extra=True)
    out = {r["doc_id"]: r for r in lang_id.predict(docs, lang_id.learnt(docs)).collect()}
    for i in (3, 4, 5):
        assert out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["rejected"]
    assert out[7]["lang_pred"] in ("en", "de", "fr", "es")
    assert lang_id.learnt(empty(spark)) == {}
    assert {r["lang_pred"] for r in lang_id.predict(docs, {}).collect()} == {"und"}
    assert lang_id.predict(empty(spark), {}).count() == 0


def test_dictionaries_are_bounded(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = lang_id.fit(docs, max_docs=7, dict_bytes=1000)
    assert all(len(x) <= 1000 + 7 for x in found.values())


COMMON = pathlib.Path("/usr/share/common-licenses")


def licences(spark, texts):
    rows = license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    return sorted(((r["doc_id"], r["license"], r["contains"], r["notices"], r["n_notice_lines"]) for r in rows), key=repr)


def test_licences(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + license_scan.MIT.replace("software", "Software").replace('"', "'")
    british = license_scan.UNLICENSE.upper()
    commented = "code()\n" + "\n".join("# " + x for x in textwrap.wrap(license_scan.MIT, 50)) + "\nmore code"
    both = f"{license_scan.BSD_START}\n{license_scan.BSD_END}\nand\n{license_scan.ISC}"
    texts = [(1, mit), (2, "some text\nreleased under the mit licence\nLicensed under CC-BY-NC 4.0"), (3, None), (4, ""), (5, british), (6, license_scan.MIT + " and more"), (6, "Released under the MIT License."), (7, "© 2021 X. All rights reserved."), (8, commented), (9, both), (10, license_scan.MIT[:-20])]
    assert licences(spark, texts) == sorted([(1, "MIT", "MIT", None, 0), (2, None, None, "CC-BY-NC-4.0,MIT", 2), (3, None, None, None, 0), (4, None, None, None, 0), (5, "Unlicense", "Unlicense", None, 0), (6, None, "MIT", None, 0), (6, None, None, "MIT", 1), (7, None, None, None, 0), (8, None, "MIT", None, 0), (9, None, "BSD-2-Clause,ISC", None, 0), (10, None, None, None, 0)], key=repr)
    assert license_scan.scan(awkward(spark, extra=True)).count() == awkward(spark).count()
    assert license_scan.scan(empty(spark)).count() == 0


@pytest.mark.skipif(not COMMON.exists(), reason="the texts are not on this machine")
def test_long_licences(spark, duck):
    names = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0"}
    texts = {n: (COMMON / n).read_text() for n in names}
    rows = [(i, t) for i, t in enumerate(texts.values())] + [(100 + i, f"word {i}\n\n{' '.join(t.split())}\n\nand more") for i, t in enumerate(texts.values())] + [(200 + i, t.replace("the", "thee")) for i, t in enumerate(texts.values())]
    got = {r[0]: r[1:] for r in licences(spark, rows)}
    for i, name in enumerate(names.values()):
        assert got[i][:2] == (name, name), name
        assert got[100 + i][:2] == (None, name), name
        assert got[200 + i][:2] == (None, None), name


def test_licences_agree_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [(1, "x\n" + license_scan.ZLIB), (2, license_scan.TEXTS[0][1]), (3, "Released under CC0 1.0.\n\n" + license_scan.BSD_START + license_scan.BSD_END), (4, None), (5, " "), (6, (COMMON / "MPL-2.0").read_text() if COMMON.exists() else "none")]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert same_rows(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")), con, license_scan.SQL) == 6


def chunked(text):
    import hashlib

    lines, out, prev = text.split("\n"), [], 0
    for x in lines:
        h = int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
        if not out or out[-1][1]:
            out.append([[], False])
        out[-1][0].append(x)
        out[-1][1] = (h + 31 * prev) % 3 == 0
        prev = h
    return [c for c, _ in out]


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    pool = [f"line {i}" for i in range(40)]
    block = [f"shared {i}" for i in range(20)]
    rows = []
    for i in range(60):
        own = [rng.choice(pool) for _ in range(rng.randint(1, 12))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + (block if i % 3 == 0 else []) + own[at:])))
    first, want = {}, {}
    for i, text in rows:
        kept, place = [], 0
        for c in chunked(text):
            owner = first.setdefault(tuple(c), (i, place)) if len(c) > 1 else (i, place)
            place += len(c)
            if owner == (i, place - len(c)):
                kept += c
        want[i] = ("\n".join(kept), len(text.split("\n")) - len(kept))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup(docs).collect()}
    assert got == want and sum(n for _, n in want.values()) > 200


def without_repeats(rows):
    """doc_id -> text, by whole spans of lines and without hashes; rows in the order of doc_id."""
    first, out = {}, {}
    for i, text in rows:
        lines, gone, spans, place = text.split("\n"), set(), set(), 0
        for c in chunked(text):
            spans |= {(place, len(c))} if len(c) > 1 else set()
            place += len(c)
        at = [k for k, x in enumerate(lines) if words(x)]
        spans |= {(a, b - a + 1) for a, b in zip(at, at[1:])} | {(k, 1) for k in at if len(words(lines[k])) > 50 or len(lines) == 1}
        for start, n in sorted(spans):
            if first.setdefault(tuple(lines[start : start + n]), (i, start)) != (i, start):
                gone |= set(range(start, start + n))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_short_passages_go_wherever_they_stand(spark):
    rng = random.Random(7)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[new(60)], [new(8), new(9)], [new(70), "", new(5)], [new(4), new(4), new(4)], [new(12) for _ in range(9)]]
    rows = [(0, new(30)), (1, new(51))]
    for i in range(2, 60):
        own = [rng.choice(["", new(6), new(55)]) for _ in range(rng.randint(2, 6))]
        at = rng.randint(1, len(own) - 1)
        rows.append((i, "\n".join(own[:at] + [new(3)] + passages[i % 5] + [new(3)] + own[at:])))
    rows += [(60, rows[0][1]), (61, rows[1][1]), (62, ""), (63, "\n\n"), (64, "\n\n")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.stage(docs).collect()}
    assert got == without_repeats(rows)
    for k, lines in enumerate(passages):
        holders = [i for i, t in rows if "\n".join(lines) in t]
        assert holders[0] == 2 + (k - 2) % 5 and len(holders) > 10
        assert all((x in got[i].split("\n")) == (i == holders[0]) for i in holders for x in lines if x)
    assert got[0] and got[1] and not got[60] and not got[61] and got[63] == "\n\n"


def test_lines_of_awkward_rows(spark):
    docs = awkward(spark, extra=True)
    out = line_dedup.stage(docs)
    assert out.columns == docs.columns
    key = lambda r: (r["doc_id"] or 0, r["text"] or "")
    assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect()))
    twin = "p q\nr s\nt u\nv w\nx y\n1\n2\n3\n4\n5"
    same = spark.createDataFrame([(1, twin), (1, twin), (None, twin)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.dedup(same).collect())
    assert got[0][1] == 0 and got[1] == got[2] and got[1][1] > 0
    assert line_dedup.dedup(empty(spark)).count() == 0


def sources(sizes, weights=(5, 2, 1)):
    """source -> target, by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, total, out = {s: weights[i % 3] for i, s in enumerate(names)}, sum(sizes.values()), {}
    open_, left = set(names), float(total)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["a", "b", "c", "d", None, "Z", "é"]) if i > 20 else "tiny") for i in range(400)]
    rows[5:21] = [(i, "w", "tiny") for i in range(5, 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    slim = docs.select(F.struct("doc_id").alias("rid"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("size"), F.lit(1.0).alias("weight"))
    out = mixing.mix(slim).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    want = sources(size)
    taken = {s: 0 for s in size}
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["epochs"] * r["size"] <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) < 1.001 for s in size)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(slim.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_better_documents_are_drawn_more_often(spark):
    n = 2000
    rows = spark.range(n).select(F.struct(F.col("id").alias("doc_id")).alias("rid"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 4 < 2, 4.0).otherwise(1.0).alias("weight"))
    out = mixing.mix(rows, weights=(1.0, 3.0))
    part = {r["weight"]: r["n"] for r in out.where("source = 'a' and part > 0").groupBy("weight").agg(F.count("*").alias("n")).collect()}
    assert part[4.0] > 1.5 * part[1.0] and abs(part[4.0] + part[1.0] - n // 4) <= 1


def test_mixed_documents(spark):
    docs = awkward(spark, extra=True)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    out = mixing.mix_documents(docs, labels)
    assert out.columns == docs.columns
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(v <= 6 for v in n.values())
    given = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} <= given
    assert mixing.mix_documents(empty(spark), labels).count() == 0
    op = mixing.op3(spark, SMALL)
    assert op.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_languages_of_few_texts_in_many_copies_are_learnt(spark):
    german = [f"der alte Mann ging {i} Mal durch den Wald und sah die Sonne nicht" for i in range(20)]
    english = [f"the old man walked {i} times through the forest and did not see the sun" for i in range(300)]
    rows = spark.createDataFrame([(t, "de") for t in german] + [(t, "en") for t in english], "text string, lang string")
    many = rows.join(spark.range(500).toDF("_n"), F.when(F.col("lang") == "de", True).otherwise(F.col("_n") == 0)).drop("_n")
    found = lang_id.fit(many, max_docs=5)
    assert set(found) == {"de", "en"}
    told = lang_id.predict(spark.createDataFrame([("der Hund schlief im Wald",), ("the dog slept in the forest",)], "text string"), found)
    assert [r["lang_pred"] for r in told.collect()] == ["de", "en"]


def test_languages_beyond_the_bound_are_reported(spark):
    rows = spark.createDataFrame([(f"text {i} of {k}", f"l{k}") for k in range(6) for i in range(9 - k)], "text string, lang string")
    with pytest.warns(UserWarning, match="2 languages"):
        assert list(lang_id.fit(rows, max_langs=4)) == ["l0", "l1", "l2", "l3"]


def test_lines_of_any_length_are_looked_up_where_asked(spark):
    rows = [(1, "own one\nshort line\nown two"), (2, "own three\nshort line\nown four"), (3, "\n"), (4, "x\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = lambda **k: {r["doc_id"]: r["text"] for r in line_dedup.stage(docs, **k).collect()}
    assert texts() == dict(rows)
    assert texts(alone=0) == dict(rows) | {2: "own three\nown four"}
