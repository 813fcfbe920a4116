"""License scan, vector dedup, Jaccard join, language ID, LM scores, quality rules and the pipeline, against brute force."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veritloom.llm import bloom_lm
from veritloom.llm.components import connected_components
from veritloom.llm.hashing import word_hashes
from veritloom.llm.itq_dedup import near_duplicate_vectors
from veritloom.llm.jaccard_join import jaccard_components
from veritloom.llm.language_id import document_rows, identify, page_rows, strip_markup, training_rows
from veritloom.llm.license_scan import license_scan, rules
from veritloom.llm.license_rules import BASE_RULES, RULES, parsed
from veritloom.llm.quality_rules import quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1.0) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# Words and components


def test_word_hashes_depend_on_the_word_alone():
    words = [b"a", b"ab", b"ba", b"the", b"x" * 700_000, b"y" * 10, "é".encode()]
    alone = [word_hashes(w)[0] for w in words]
    assert len(set(alone)) == len(words)
    for gap in (b" ", b"\n\t \x0b\x0c\r"):
        assert word_hashes(gap + gap.join(words * 2) + gap).tolist() == alone * 2
    assert len(word_hashes(b"")) == len(word_hashes(b" \n")) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 400), (400, 500)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 400: 400, 500: 400}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# License scan

LICENSED = [
    (1, "Released under the MIT License."), (2, None), (3, ""), (4, "cc by nc, CC-BY-NC 4.0; Apache License, Version 2.0! under the MIT\nlicense under the mit licensee"),
    (5, "GNU General Public License version 3 or later"), (6, "gpl"), (None, "under the mit license"), (6, "gpl"), (7, "permit mit"), (8, "Kelvin under the mit licenſe"), (9, "x " * 20_000 + "cc by nc " * 300),
]


def scan(text):
    """n_words and (rule, start, end) that stay, by looking at every pair of detections."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line = " " + "  ".join(words) + " "
    found = []
    for number, label, priority, confidence, keyword, pattern in rules():
        if keyword in words:
            for m in re.finditer(pattern, line):
                start = line[: m.start()].count(" ") // 2
                found.append((number, start, start + m[0].count(" ") // 2, label, priority, confidence))
    stay = [
        d for d in found
        if d[4] == 4 or not any(e is not d and e[1] <= d[1] and e[2] >= d[2] and (e[4] > d[4] or e[4] == d[4] and (e[2] - e[1] > d[2] - d[1] or (e[1], e[2]) == (d[1], d[2]) and e[0] < d[0])) for e in found)
    ]
    return len(words), stay


def test_license_scan(spark, rows):
    cases = LICENSED + [(1000 + i, t) for i, t in list(rows.items())[:60]]
    found = collections.Counter()
    for r in license_scan(frame(spark, cases)).collect():
        found[r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score] += 1
    expected = collections.Counter()
    for i, text in cases:
        n, stay = scan(text)
        base = [d for d in stay if d[4] == 4]
        starts = [d[1] for d in base]
        expected[i, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({d[3] for d in base})), ",".join(sorted({d[3] for d in stay})), max((d[5] for d in stay), default=0.0)] += 1
    assert found == expected


def test_license_rules_are_many_and_gated():
    table = parsed(BASE_RULES) + parsed(RULES)
    assert len(table) >= 200
    for _, priority, confidence, keyword, pattern in table:
        assert priority in (1, 2, 3, 4) and 0 < confidence <= 1
        assert re.search(rf"(?<![a-z0-9]){keyword}(?![a-z0-9\[])", pattern)


def test_license_scan_of_nothing(spark):
    assert license_scan(frame(spark, [])).count() == 0


# Vectors


def brute_vectors(rows, cosine=0.9):
    good = [(k, i, np.array(v, float) / np.max(np.abs(v))) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = collections.Counter(), {i: i for _, i, _ in good}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (k, i, x), (m, j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[k] += 1
                links[m] += 1
                lo, hi = sorted((top(i), top(j)))
                parent[hi] = lo
    return [(i, links[k], None if i is None else top(i) if i in parent else i) for k, (i, _) in enumerate(rows)]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    rows = [(100 + k, (centres[k % 60] + 0.12 * rng.standard_normal(16)).tolist()) for k in range(400)]
    rows += [(k, centres[0].tolist()) for k in (9, 8, 7, 6)] + [(1, None), (2, []), (3, [0.0] * 16), (4, [math.nan] * 16), (5, [1.0, None] * 8), (50, [1.0, 2.0]), (51, [2.0, 4.0]), (None, centres[0].tolist()), (60, [1e-320] * 16), (61, [1e300] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links) for r in near_duplicate_vectors(df).collect())
    expected = sorted((i if i is not None else -1, n) for i, n, _ in brute_vectors(rows))
    both, all_ = sum(n for _, n in found), sum(n for _, n in expected)
    assert [i for i, _ in found] == [i for i, _ in expected]
    assert all(a <= b for (_, a), (_, b) in zip(found, expected, strict=True)), "a link below the cosine"
    assert both >= 0.9 * all_, "recall"
    again = near_duplicate_vectors(df).collect()
    if both == all_:
        of = lambda i, c: (-1 if i is None else i, -1 if c is None else c)
        assert sorted(of(r.vec_id, r.component_id) for r in again) == sorted(of(i, c) for i, _, c in brute_vectors(rows))
    kept = {r.vec_id: (r.component_id, r.kept) for r in again}
    assert kept[6][0] == 6 and kept[9] == (6, False) and kept[1] == (1, True) and kept[51] == (50, False) and kept[None] == (None, False)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_vector_tables_grow_with_the_vectors():
    """More bits and tables for more vectors: as many pairs at the cosine meet, and fewer of the others."""
    from veritloom.llm import itq_dedup

    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal(x.shape)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    near = 0.9 * x + math.sqrt(0.19) * off / np.linalg.norm(off, axis=1, keepdims=True)
    rates = []
    for n in (1 << 16, 1 << 20, 1 << 24):
        width, tables = itq_dedup.plan_tables(n)
        projection = itq_dedup.fit_rotation(x, width * tables)
        code, other = (itq_dedup.encode(v, projection, width) for v in (x, near))
        assert (code == other).any(axis=1).mean() >= 0.9
        rates.append((code[:-1] == code[1:]).any(axis=1).mean())
    assert rates[0] > 3 * rates[1] > 9 * rates[2]


def test_vector_tiles(spark, monkeypatch):
    from veritloom.llm import itq_dedup

    monkeypatch.setattr(itq_dedup, "TILE", 7)
    rng = np.random.default_rng(4)
    rows = [(k, (np.ones(8) + 0.05 * rng.standard_normal(8)).tolist()) for k in range(60)]
    found = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert all(r.n_links == 59 and r.component_id == 0 for r in found)


# Jaccard join


def brute_jaccard(rows, percent=85, size=4):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and None not in (rows[a][0], rows[b][0]) and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((top(rows[a][0]), top(rows[b][0])))
                parent[hi] = lo
    return sorted((i if i is not None else -1, len(s), None if i is None else top(i)) for (i, _), s in zip(rows, sets, strict=True))


def near_copies(seed):
    """Groups of near copies around the threshold, a passage that all share, and odd rows."""
    import random

    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    shared = rng.choices(words, k=30)
    out, at = [], 10
    for group in range(6):
        base = rng.choices(words, k=rng.choice([12, 60, 150]))
        for _ in range(14):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append((at, " ".join(text + shared * (group % 2))))
            at += 1
    odd = [(1, None), (2, ""), (3, " \n"), (4, "Two words"), (5, "two WORDS"), (6, "a b c d"), (None, "a b c d"), (7, "A b  c\td"), (7, "something else entirely here now"), (8, "something else entirely here NOW"), (9, "x " * 3000), (900, "x x x x")]
    return out + odd


def side_by_side(tables):
    """Many tables as one: ids and words of each are its own, so that nothing links across; rows without ids or words stay as they are."""
    for k, rows in enumerate(tables):
        yield [(i if i is None else i + 1_000_000 * k, t and " ".join(f"t{k}.{w}" for w in t.split())) for i, t in rows]


def components(spark, rows, **parameters):
    found = jaccard_components(frame(spark, rows), **parameters).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in found)


def brute_components(tables, percent=85, size=4):
    return sorted((i, n, -1 if c is None else c) for rows in tables for i, n, c in brute_jaccard(rows, percent, size))


def test_jaccard(spark):
    tables = [near_copies(1), *side_by_side([near_copies(seed) for seed in (1, 2)])]
    assert components(spark, [r for rows in tables for r in rows]) == brute_components(tables)


def test_jaccard_of_repeated_ids(spark):
    """In twenty tables a third of the rows share ids with other texts; some are copies of whole rows, or differ in case only."""
    tables = []
    for seed in range(3, 23):
        rng = random.Random(seed)
        rows = [(i if i is None or rng.random() < 0.7 else rng.randrange(10, 60), t) for i, t in near_copies(seed)]
        tables.append(rows + rng.choices(rows, k=15) + [(i, t.upper()) for i, t in rng.choices(rows, k=5) if t])
    tables = list(side_by_side(tables))
    rows = [r for rows in tables for r in rows]
    random.Random(1).shuffle(rows)
    assert components(spark, rows) == brute_components(tables)


def large_group(seed, length):
    """Copies of one text with up to two thirds of the edits that a link allows, and beyond; edits recur among them."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=length)
    rows = [(5000, " ".join(base))]
    for i in range(220):
        text = list(base)
        for _ in range(rng.randrange(0, max(2, length // 18))):
            spot = rng.randrange(len(text))
            kind = rng.random()
            if kind < 0.4:
                del text[spot]
            else:
                text[spot] = rng.choice(words[:12]) if kind < 0.8 else f"own{i}{spot}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("percent", "size"), [(85, 4), (80, 5)])
def test_jaccard_in_large_groups_around_the_threshold(spark, percent, size):
    tables = list(side_by_side([large_group(seed, length) for seed, length in enumerate((40, 60, 150, 400))]))
    assert components(spark, [r for rows in tables for r in rows], percent=percent, size=size) == brute_components(tables, percent, size)


def test_jaccard_of_words_made_to_collide(spark):
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    one, other = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rows = [(k, f"{word} and {'common ' * k}words") for k, word in enumerate([one, other, one, other])] + [(10, f"same {one}"), (11, f"same {other}"), (12, f"same {one}")]
    assert components(spark, rows) == brute_components([rows])


def test_jaccard_of_nothing(spark):
    assert jaccard_components(frame(spark, [])).count() == 0
    assert jaccard_components(frame(spark, [(1, None)])).collect()[0].component_id == 1


# Language


def test_language_accuracy_on_held_out_documents(spark, docs):
    """Fitted on three quarters of the documents, right on the rest without their declarations."""
    train, test = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0 and n_chars > 100")
    rows = test.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.lit("h").alias("host"), F.lit("").alias("domain"), F.lit("-").alias("mark"))
    found = {r.id: r.lang for r in identify(rows, training_rows(train)).collect()}
    right = {r.doc_id: r.lang for r in test.collect()}
    assert len(found) == len(right) and sum(found[i] == right[i] for i in right) >= 0.98 * len(right)


def test_language_fusion_and_odd_pages(spark, docs):
    page = lambda lang, text: f'<html lang="{lang}"><script>var x = "the";</script><body><p>{text}</p></body></html>'
    german = next(r.text for r in docs.where("lang = 'de' and n_chars > 300").collect())
    pages = [(k, f"http://de.example.org/p{k}", page("de", german)) for k in range(20)]
    pages += [(100, "http://de.example.org/empty", page("", "")), (101, None, None), (102, "nonsense", ""), (103, "http://de.example.org/x", page("de", german)), (103, "http://de.example.org/x", page("de", german)), (None, "http://a/de/1", page("xx", german))]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, host string")
    found = identify(page_rows(df), training_rows(docs), markup=True).collect()
    assert len(found) == len(pages)
    by = {r.id: r for r in found}
    assert by[0].lang == by[0].text_lang == "de" and by[0].kept and by[0].declared == "de"
    assert by[100].text_lang is None and by[100].lang == "de" and not by[100].kept, "the host's other pages decide"
    assert not by[101].kept and not by[102].kept and by[None].lang == "de" and by[None].declared == "other"
    assert identify(page_rows(df.limit(0)), training_rows(docs)).count() == 0
    assert {r.lang for r in identify(page_rows(df), training_rows(docs.limit(0))).collect()} == {None}


def brute_language(rows, training):
    """(lang, confidence, margin) of rows (text, declared, host, domain, mark) by plain sums; training: (text, lang)."""
    from veritloom.llm.language_id import EFFECTIVE, FEATURES, SMOOTHING, trigrams

    languages = sorted({lang for _, lang in training})
    counts = np.array([sum((np.bincount(trigrams(t), minlength=FEATURES) for t, lang in training if lang == k), np.zeros(FEATURES)) for k in languages]) + 0.5
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    share = np.array([sum(lang == k for _, lang in training) for k in languages]) / len(training)
    found = []
    for text, *_ in rows:
        at = trigrams(text)
        mean = logs[:, at].mean(axis=1) if len(at) else np.zeros(len(languages))
        found.append((mean * min(len(at), EFFECTIVE), mean.max() + math.log(FEATURES) if len(at) else 0.0))
    soft = [np.exp(x - x.max()) * share / (np.exp(x - x.max()) * share).sum() for x, _ in found]
    total = sum(soft)
    prior = (total + 1) / (total.sum() + len(languages))
    near = lambda match: (sum((soft[m] for m in range(len(rows)) if match(rows[m])), np.zeros(len(languages))), sum(map(match, rows)))
    out = []
    for k, (_, declared, host, domain, mark) in enumerate(rows):
        of_domain, n_domain = near(lambda r: r[3] == domain)
        wide = (of_domain + SMOOTHING * prior) / (n_domain + SMOOTHING)
        of_host, n_host = near(lambda r: r[2:4] == (host, domain))
        post = found[k][0] + np.log((np.maximum(of_host - soft[k], 0) + SMOOTHING * wide) / (n_host - 1 + SMOOTHING))
        for value, column in ((declared, 1), (mark, 4)):
            have, n = near(lambda r: r[column] == value)
            post = post + np.log((have + SMOOTHING * n / total.sum()) / (total + SMOOTHING))
        out.append((languages[int(post.argmax())], 1 / np.exp(post - post.max()).sum(), found[k][1]))
    return out


def test_language_posterior(spark):
    """Every figure of the fusion, where evidence agrees, disagrees and lacks."""
    words = {"aa": "the of and that with this from house water".split(), "bb": "der die und das mit dieser aus haus wasser".split(), "cc": "el la y que con este desde casa agua".split()}
    rng = random.Random(8)
    said = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    training = [(said(lang, 40), lang) for lang in ("aa", "aa", "aa", "bb", "bb", "cc")]
    rows = [(said(rng.choice("ab") * 2, rng.choice([0, 1, 2, 30, 200])), rng.choice(["aa", "bb", "none", "other"]), f"h{rng.randrange(4)}", f"d{rng.randrange(2)}", rng.choice(["m1", "m2"])) for _ in range(60)]
    rows += [("mit", "aa", "h9", "d9", "m1"), ("", "bb", "h1", "d1", "m2"), ("хтось десь колись", "none", "h1", "d1", "m2")]
    told = {"none": None, "other": "zz"}
    frame = spark.createDataFrame([(k, t, told.get(d, d), h, dom, m) for k, (t, d, h, dom, m) in enumerate(rows)], "id bigint, text string, declared string, host string, domain string, mark string").repartition(3)
    sample = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(training)], "id bigint, text string, lang string")
    found = {r.id: r for r in identify(frame, sample).collect()}
    fused = 0
    for k, (lang, confidence, margin) in enumerate(brute_language(rows, training)):
        r = found[k]
        assert r.lang == lang and abs(r.confidence - confidence) < 1e-9 and abs(r.margin - margin) < 1e-9
        assert r.kept == (r.n_features > 0 and confidence >= 0.5 and margin >= 0)
        fused += r.n_features > 0 and r.text_lang != lang
    assert fused and not found[len(rows) - 1].kept


def test_language_of_no_known_text(spark, docs):
    """Text of none of the sample's languages goes, whatever its host says; repeated rows of the sample count once."""
    unknown = ["Это текст на языке которого нет в выборке " * 8, "xqzt vkjq zzxq wvkj qqzx kjxv " * 20, "zażółć gęślą jaźń szczebrzeszyn brzmi w trzcinie chrząszcz " * 5]
    df = spark.createDataFrame([(9_000_000 + k, t, "s") for k, t in enumerate(unknown)], "doc_id bigint, text string, source string")
    train = training_rows(docs.union(docs.where("doc_id = 1")).union(docs.where("doc_id = 1")))
    both = document_rows(docs.select("doc_id", "text", "source")).union(document_rows(df))
    found = {r.id: r for r in identify(both, train).collect()}
    assert not any(found[9_000_000 + k].kept for k in range(len(unknown)))
    assert sum(r.kept for r in found.values()) >= 0.99 * docs.count()


def test_strip_markup():
    assert strip_markup("<p>a<!-- b --> &amp; <SCRIPT>x</SCRIPT>c</p>").split() == ["a", "&", "c"]
    assert strip_markup(None) == ""


# Language model


def test_base_scores_are_exact(spark, rows, docs):
    bits = [bin(k).count("1") % 2 for k in range(1 << 13)]
    odd = ["".join(letters[x] for x in bits[:n]) for n in (1024, 2048, 1 << 13) for letters in ("ab", "ba")]  # a weak hash takes them for equal
    cases = [*rows.items(), (9001, None), (9002, ""), (None, "the of"), (9003, "THE unseenword"), (9003, "the"), *((9100 + k, w) for k, w in enumerate(odd)), (9200, " ".join(odd[::2]))]
    found = bloom_lm.score_documents(frame(spark, cases)).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = collections.Counter(w for i, t in cases if not held(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(t))
    key = lambda i, t: (i if i is not None else -1, len(tokens(t)))
    expected = sorted((*key(i, t), held(i), sum(counts[w] > 0 for w in tokens(t)), total, round(base(t), 6)) for i, t in cases)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.held_out, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 for r in found)


def test_model_finds_repeated_text_likelier(spark):
    """Pairs of words seen in training raise the score of a held-out copy."""
    from random import Random

    rng = Random(1)
    words = [f"w{k}" for k in range(500)]
    passage = " ".join(rng.choices(words, k=60))
    cases = [(i, passage if i % 10 == 0 else " ".join(rng.choices(words, k=60))) for i in range(400)]
    found = {r.doc_id: r for r in bloom_lm.score_documents(frame(spark, cases)).collect() if r.held_out}
    gain = lambda rs: np.mean([r.score - r.base_score for r in rs])
    assert gain([r for i, r in found.items() if i % 10 == 0]) > gain([r for i, r in found.items() if i % 10]) + 10


def test_filter_levels(spark):
    rng = np.random.default_rng(2)
    keys, level = rng.integers(1, 1 << 63, 5000, dtype=np.uint64), rng.integers(1, 12, 5000)
    table = lambda a, b: spark.createDataFrame(list(zip(keys[a:b].view(np.int64).tolist(), level[a:b].tolist(), strict=True)), "key bigint, level int")
    bits = bloom_lm.build_filter(table(0, 3000), table(3000, 5000))
    found = bloom_lm.levels(keys, bits)
    kept = np.concatenate([level[:3000], np.where(level[3000:] >= 2, level[3000:], 0)])
    assert (found >= kept).all() and (found == kept).mean() > 0.99
    assert (bloom_lm.levels(rng.integers(1, 1 << 63, 5000, dtype=np.uint64), bits) == 0).mean() > 0.99


def test_every_pair_is_in_the_model(spark):
    """Scores follow the counts of all n-grams, pairs seen once as well, whatever their number."""
    cases = [(i, " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(300))) for i in range(300)]
    held = {i for i, _ in cases if zlib.crc32(str(i).encode()) % 5 == 1}
    lists = {i: [*t.split(), "\n"] for i, t in cases}
    words = collections.Counter(w for i, ws in lists.items() if i not in held for w in ws)
    pairs = collections.Counter(p for i, ws in lists.items() if i not in held for p in zip(["\n", *ws], ws))
    assert sum(n == 1 for n in pairs.values()) > 1000
    steps, stands = bloom_lm.thresholds(), bloom_lm.representatives()
    stand = lambda n: stands[np.searchsorted(steps, n, side="right")]
    below = sum(words.values()) + 0.5 * (len(words) + 1)

    def score(ws):
        out = 0.0
        for first, w in zip(["\n", *ws], ws):
            alone, c = (stand(words[w]) + 0.5) / below, stand(words[first])
            out += math.log10(0.3 * min(1.0, stand(pairs[first, w]) / max(c, 1.0)) + 0.7 * alone if c else alone)
        return out

    # False positives of the filter, about one probe in 700, raise single tokens by little.
    gaps = [r.score - score(lists[r.doc_id]) for r in bloom_lm.score_documents(frame(spark, cases)).collect()]
    assert len(gaps) == len(cases) and np.mean(np.abs(gaps)) < 0.5


def test_filter_grows_with_its_entries():
    """No level is left out and absent keys stay absent, however many there are."""
    rng = np.random.default_rng(3)
    for n in (1000, 200_000):
        keys, level = rng.integers(1, 1 << 63, n, dtype=np.uint64), rng.integers(1, 4, n)
        bits = bloom_lm.filter_of(keys, level)
        found = bloom_lm.levels(keys, bits)
        assert (found >= level).all() and (found == level).mean() > 0.99
        assert (bloom_lm.levels(rng.integers(1, 1 << 63, n, dtype=np.uint64), bits) == 0).mean() > 0.99


def test_scores_of_nothing(spark):
    assert bloom_lm.score_documents(frame(spark, [])).count() == 0


# Quality


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    n = collections.Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if n[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def brute_ratio(cases, good):
    """Every document's mean log ratio of its words and pairs, and the least one that passes."""
    import xxhash

    from veritloom.llm.quality_rules import BUCKETS, LEAST_WORDS, SPREADS

    def features(text):
        w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        return [h % BUCKETS for h in one] + [xxhash.xxh64_intdigest(y, h) % BUCKETS for h, y in zip(one, w[1:])]

    found = [features(t) for _, t in cases]
    raw = np.bincount([f for x in found for f in x], minlength=BUCKETS) + 1
    target = np.bincount([f for (i, _), x in zip(cases, found, strict=True) if i in good for f in x], minlength=BUCKETS) + 1
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    score = [float(ratio[x].mean()) if x else 0.0 for x in found]
    trusted = [s for s, (i, _), x in zip(score, cases, found, strict=True) if i in good and (len(x) + 1) // 2 >= LEAST_WORDS]
    return score, np.mean(trusted) - SPREADS * np.std(trusted)


def test_quality(spark, rows, docs, small):
    cases = [*rows.items(), (9001, None), (9002, ""), (9003, "a b a b a b a"), (None, "x\n\nx\n \nx"), (9004, "😀 é #\n\x0b\x1c b"), (9004, "dup"), (9005, "p q r " * 4000), (9006, "\n\n \n\n")]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    found = quality_rules(frame(spark, cases), labels.union(labels)).collect()
    key = lambda i: i if i is not None else -1
    expected = sorted((key(i), *measures(t)) for i, t in cases)
    assert sorted((key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == expected
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    score, least = brute_ratio(cases, {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic})
    assert sorted((key(r.doc_id), round(r.score, 6)) for r in found) == sorted((key(i), round(x, 6)) for (i, _), x in zip(cases, score, strict=True))
    assert all(r.kept == (not r.base_failed and r.score >= least) for r in found if abs(r.score - least) > 1e-6)
    label = {r.doc_id: r for r in labels.collect()}
    judged = [(r.kept, label[r.doc_id]) for r in found if r.doc_id in label and not r.base_failed]
    assert all(kept for kept, x in judged if x.quality == 1 and not x.toxic), "clean documents stay"
    assert sum(not kept for kept, x in judged if x.quality == 0) >= 0.9 * sum(x.quality == 0 for _, x in judged)


def test_quality_learns_from_every_trusted_document(spark):
    """More labelled good documents than any bounded sample took (16,384)."""
    cases = [(i, f"w{i % 977} v{i % 1009} u{i}" if i % 50 else " ".join(f"w{(i + k * k) % 977}" for k in range(60))) for i in range(20_000)]
    good = {i for i, _ in cases if i % 8 != 1}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i, _ in cases], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in quality_rules(frame(spark, cases), labels).collect()}
    score, least = brute_ratio(cases, good)
    assert len(good) > 1 << 14 and len(found) == len(cases)
    assert max(abs(found[i].score - x) for (i, _), x in zip(cases, score, strict=True)) < 1e-6
    assert all(r.kept == (not r.base_failed and r.score >= least) for r in found.values() if abs(r.score - least) > 1e-6)


def test_quality_without_labels_or_rows(spark, rows):
    assert quality_rules(frame(spark, []), None).count() == 0
    for r in quality_rules(frame(spark, list(rows.items())[:20]), None).collect():
        assert r.score == 0.0 and r.kept == (not r.base_failed)


# Pipeline


def test_pipeline(spark, small, docs):
    """Each stage against what its operator says of the stage's input."""
    kept = docs
    n = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, small)
        assert after.columns == docs.columns
        after = after.cache()
        n.append(after.count())
        if name == "quality rules":
            say = {r.doc_id for r in quality_rules(kept, spark.read.parquet(f"{small}/labels.parquet")).collect() if r.kept}
            assert {r.doc_id for r in after.collect()} == say
        if name == "n-gram Jaccard join":
            say = {c for i, _, c in brute_jaccard([(r.doc_id, r.text) for r in kept.collect()], 80, 5)}
            assert {r.doc_id for r in after.collect()} == say and n[-1] == len(say)
        kept = after
    assert 0 < n[2] < n[1] <= n[0] < docs.count()
    placed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in placed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}


def test_pipeline_joins_at_five_words_and_four_fifths(spark, docs, small):
    """Near copies from 0.80 in shingles of five words, which are under 0.85 in those of four."""
    words = [f"w{k}" for k in range(230)]
    edited = lambda n: " ".join("edit" if k % 20 == 10 and k < 20 * n else w for k, w in enumerate(words))
    cases = [(n + 1, edited(n)) for n in (0, 5, 10)] + [(50, "of its own " * 9)]

    def alike(x, y, size):
        a, b = ({tuple(t.split()[k : k + size]) for k in range(len(t.split()) - size + 1)} for t in (x, y))
        return len(a & b) / len(a | b)

    texts = dict(cases)
    assert alike(texts[1], texts[6], 5) >= 0.8 and alike(texts[1], texts[6], 4) < 0.85
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in cases], docs.schema)
    stay = {i for i, t in cases if not any(j < i and alike(t, u, 5) >= 0.8 for j, u in cases)}
    assert {r.doc_id for r in corpus_pipeline.jaccard_join(spark, rows, small).collect()} == stay


def test_pipeline_keeps_columns_whatever_their_names(spark, docs, small):
    """Columns named like those of the stages, and ids of several texts."""
    names = ["row", "id", "key", "gone", "several", "kept", "a.b", "_key"]
    more = docs.limit(40).selectExpr("doc_id", "text", "lang", "source", "n_chars", *(f"concat('{n}', doc_id) as `{n}`" for n in names))
    other = more.where("doc_id = 3").withColumn("text", F.concat(F.reverse("text"), F.lit(" so another text")))
    rows = more.union(other).union(more.where("doc_id = 5"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, small)
        assert after.columns == rows.columns
        ids = [r.doc_id for r in after.collect()]
        if name == "n-gram Jaccard join":
            assert ids.count(3) == 2 and ids.count(5) <= 1
        assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in rows.collect()}


def test_pipeline_with_odd_rows(spark, tmp_path, docs, small):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 100, None, None, None)], docs.schema)
    twice = docs.limit(30)
    for name, df in (("documents", twice.union(twice).union(odd)), ("labels", spark.read.parquet(f"{small}/labels.parquet"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
