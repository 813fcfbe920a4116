"""Order-dependent and iterative graph operators against plain Python."""

from __future__ import annotations

import collections
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from veritloom.functions import text as T
from veritloom.operators import chat, extract, graph, labels, layout, relate, similarity, validate
from veritloom.plans import projection
from veritloom.plans.ingest import ingest
from veritloom.sources import tables
from veritloom.streaming.ingest import stream_ingest


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first()["x"]


def units_of(spark, content, column):
    return [(u["text"], u["start"], u["end"]) for u in one(spark, content, column(F.col("v")))]


# Extraction


def test_sentences_slice_back(spark):
    content = "First sentence here is long.  Short. Another one, with é accents! Is it? The last one has no end"
    found = units_of(spark, content, extract.sentences)
    assert [content[a:b] for _, a, b in found] == [t for t, _, _ in found]
    assert [t for t, _, _ in found] == ["First sentence here is long", "Another one, with é accents", "The last one has no end"]


def test_bullets_and_numbers(spark):
    content = "Intro line here\n- first bullet item\n  * second bullet item\n• tiny\n\n\n1. numbered item one\n22. numbered item two\n- first bullet item"
    assert units_of(spark, content, extract.bullets) == [
        ("first bullet item", 16, 35), ("second bullet item", 36, 58), ("first bullet item", 16, 35)
    ]
    numbered = units_of(spark, content, extract.numbered)
    assert [t for t, _, _ in numbered] == ["numbered item one", "numbered item two"]
    assert content[numbered[0][1] : numbered[0][2]] == "\n\n1. numbered item one"


def test_overlaps_keep_the_first_and_dropped_units_do_not_count(spark):
    rng = random.Random(1)
    for _ in range(5):
        spans = [(s := rng.randrange(60), s + rng.randrange(1, 15)) for _ in range(25)]
        df = spark.createDataFrame([([(f"u{k}", a, b, "") for k, (a, b) in enumerate(spans)],)], f"u array<{extract.UNIT}>")
        found = [(u["text"], u["start"], u["end"]) for u in df.select(extract.drop_overlaps(F.col("u")).alias("x")).first()["x"]]
        kept, last = [], -1
        for k, (a, b) in sorted(enumerate(spans), key=lambda x: (x[1][0], x[1][1] - x[1][0], x[0])):
            if a >= last:
                kept.append((f"u{k}", a, b))
                last = b
        assert found == kept


def test_text_across_a_removed_block_vanishes(spark):
    content = 'Some words before """ a block. of text """ and words after it. A whole sentence stays here'
    assert [t for t, _, _ in units_of(spark, content, extract.parse)] == ["A whole sentence stays here"]


# Rules


@pytest.mark.parametrize(
    ("statement", "rule"),
    [
        ("Neural networks are computational models inspired by biology", None), ("This enables better performance", "SELF_CONTAINMENT"),
        ("Networks are useful. They learn patterns automatically.", "SINGLE_CLAIM"), ("Too short", "MINIMUM_LENGTH"),
        ("It uses them because they work", "SELF_CONTAINMENT"), ("That's why researchers prefer them", None), ("", "SELF_CONTAINMENT"),
        ("Carbon dioxide and water are converted into glucose and oxygen", "SINGLE_CLAIM"),
    ],
)
def test_rules(spark, statement, rule):
    found = [v["rule"] for v in one(spark, statement, validate.violations(F.col("v")))]
    assert (found == []) if rule is None else rule in found


def test_repairs(spark):
    assert one(spark, "One claim here. Two claims there", validate.suggest_repair(F.col("v"), F.lit(""))) == ["One claim here.", "Two claims there."]
    assert one(spark, "It runs quickly on hardware", validate.suggest_repair(F.col("v"), F.lit("the Old Engine was built"))) == ["Engine runs quickly on hardware"]
    assert one(spark, "This lacks any context", validate.suggest_repair(F.col("v"), F.lit(""))) == ["This lacks any context"]


def test_labels(spark):
    reply = '1: Ancient Egypt, "x", b\n3: one, two, three, four\n3: Last Wins\nnoise'
    assert one(spark, reply, T.parse_label_reply(F.col("v"), F.lit(4))) == [["ancient-egypt"], ["general"], ["last-wins"], ["general"]]
    single = labels.prompts(spark.createDataFrame([(1, 0, "only one")], "scope bigint, ord bigint, text string")).first()
    assert single.prompt == labels.SINGLE_PROMPT + "only one"
    told = labels.topic_labels(spark.createDataFrame([(1, 5, "only one"), (2, 0, "x y"), (2, 1, "z")], "scope bigint, ord bigint, text string"), lambda p: "Red, Blue" if "only" in p else "2: Green thing")
    assert sorted((r.scope, r.ord_, r.labels) for r in told.collect()) == [(1, 0, ["red", "blue"]), (2, 0, ["general"]), (2, 1, ["green-thing"])]
    units = spark.createDataFrame([(1, k, f"statement {k}") for k in range(70)], "scope bigint, ord bigint, text string")
    asked = labels.prompts(units)
    assert sorted((r.chunk, r.n) for r in asked.collect()) == [(0, 50), (1, 20)]

    def labeler(prompt: str) -> str:
        if "20. statement 69" in prompt:
            raise RuntimeError("down")
        return "1: fine"

    assert sorted((r.chunk, r.reply) for r in labels.ask(asked, labeler).collect()) == [(0, "1: fine"), (1, "")]


# Similarity and relations


def plain_similarity(a, b):
    tokens = lambda t: collections.Counter(w for w in t.lower().split() if len(w) > 1 and w not in T.VECTOR_STOPWORDS)
    x, y = tokens(a), tokens(b)
    size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return sum(x[w] * y[w] for w in x) / size if size else 0.0


def test_fuzzy_dedup_is_sequential(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(9)]
    rows = [(s, k, " ".join(rng.choices(words, k=6))) for s in range(3) for k in range(50)]
    found = {(r.scope, r.ord) for r in similarity.fuzzy_dedup(spark.createDataFrame(rows, "scope bigint, ord bigint, text string"), 0.85).collect()}
    expected = set()
    for s in range(3):
        kept = []
        for scope, k, text in rows:
            if scope == s and all(plain_similarity(text, t) < 0.85 for _, t in kept):
                kept.append((k, text))
        expected |= {(s, k) for k, _ in kept}
    assert found == expected


def test_pairs_above_a_threshold(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(25)] + ["the", "x"]
    rows = [(s, k, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for s in range(2) for k in range(60)]
    df = spark.createDataFrame(rows, "scope bigint, ord bigint, text string")
    for threshold in (0.3, 0.65, 0.85, 1.0):
        expected = {(s, i, j) for s, i, a in rows for t, j, b in rows if s == t and i < j and plain_similarity(a, b) >= threshold}
        assert {(r.scope, r.i, r.j) for r in similarity.pairwise_threshold(df, threshold).collect()} == expected
    best = {(r.scope, r.query, r.ord) for r in similarity.find_similar(df.where("ord < 5"), df, 0.65).collect()}
    assert best == {(s, i, j) for s, i, a in rows for t, j, b in rows if s == t and i < 5 and plain_similarity(a, b) >= 0.65}


def test_injected_embedder(spark):
    from veritloom.operators.embed import dense_topk, embed

    df = spark.createDataFrame([(1, 0, "aa b"), (1, 1, "aa b"), (1, 2, "b b b"), (1, 3, None)], "scope bigint, ord bigint, text string")
    found = embed(df, lambda: lambda texts: [[t.count("a"), t.count("b")] for t in texts]).orderBy("ord").collect()
    assert [r.vector for r in found] == [[2.0, 1.0], [2.0, 1.0], [0.0, 3.0], None]
    vectors = spark.createDataFrame([(1, r.ord, r.vector) for r in found[:3]], "scope bigint, ord bigint, vector array<double>")
    assert [(r.i, r.j) for r in dense_topk(vectors, 1).orderBy("i", "j").collect()] == [(0, 1), (0, 2)]


def test_topk_fills_with_zeros_in_order(spark):
    texts = ["alpha beta", "gamma delta", "alpha gamma", "solo", "other", "beta beta"]
    rows = [(1, k, t) for k, t in enumerate(texts)]
    for k in (1, 2, 4):
        expected = set()
        for i, a in enumerate(texts):
            best = sorted((j for j in range(6) if j != i), key=lambda j: (-plain_similarity(a, texts[j]), j))[:k]
            expected |= {tuple(sorted((i, j))) for j in best}
        found = {(r.i, r.j) for r in similarity.topk_similarity(spark.createDataFrame(rows, "scope bigint, ord bigint, text string"), k).collect()}
        assert found == expected


def nodes(spark, statements, terms=None):
    rows = [(1, k, f"n{k}", s, (terms or {}).get(k, []), [("f", (k, k + 1), 1.0)], "c") for k, s in enumerate(statements)]
    return spark.createDataFrame(rows, "scope bigint, ord bigint, node_id string, statement string, terms array<string>, evidence array<struct<source:string,span:struct<start:int,end:int>,confidence:double>>, context_id string")


def test_relations(spark):
    close = "engine torque curve derived from"
    found = relate.derived_from(nodes(spark, ["engine torque curve derived", "unrelated words", "engine torque curve derived", close])).collect()
    assert [(r.i, r.j) for r in found] == [(3, 0)]
    assert relate.derived_from(nodes(spark, ["engine torque curve derived", "a1", "b2", "c3", close])).count() == 0
    table = nodes(spark, ["plain", "more specifically this", "other"], {0: ["Net"], 1: ["Net", "layers"], 2: []})
    assert [(r.i, r.j) for r in relate.refines(table).collect()] == [(1, 0)]
    table = nodes(spark, ["Training requires gradient data", "x", "y"], {1: ["Gradient", "abc"], 2: ["abc", "unused"]})
    assert [(r.i, r.j) for r in relate.depends_on(table).collect()] == [(0, 1)]
    edges = relate.typed_edges(table, relate.depends_on(table), "depends_on").collect()
    assert [(r.source, r.target, r.type) for r in edges] == [("n0", "n1", "depends_on")]


# Projection


def test_capped_search_is_first_in_first_out(spark):
    rng = random.Random(5)
    names = [f"n{k:02d}" for k in range(30)]
    weights = [(*rng.sample(names, 2), rng.random(), k) for k in range(60)]
    edges = [(*rng.sample(names, 2), "depends_on", k) for k in range(20)]
    node_table = spark.createDataFrame([(n, "atomic", [], k) for k, n in enumerate(names)], "node_id string, node_type string, topic_labels array<string>, node_ord bigint")
    w = spark.createDataFrame(weights, "source string, target string, weight double, edge_ord bigint")
    e = spark.createDataFrame(edges, "source string, target string, type string, edge_ord bigint")
    for cap, depth in ((6, 2), (12, 3)):
        queue, seen = collections.deque([("n00", 0)]), {}
        while queue and len(seen) < cap:
            node, d = queue.popleft()
            if node in seen:
                continue
            seen[node] = d
            if d < depth:
                for s, t, x, _ in weights:
                    if x >= 0.3 and node in (s, t):
                        queue.append((t if s == node else s, d + 1))
                for s, t, _, _ in edges:
                    if node in (s, t):
                        queue.append((t if s == node else s, d + 1))
        found = projection.discover("n00", node_table, w, e, projection.ProjectionParameters(0.3, 5, depth, cap)).orderBy("rank").collect()
        assert [r.node_id for r in found] == list(seen)
    with pytest.raises(ValueError, match="first atomic ones are: n00, n01, .*n09$"):
        projection.discover("nobody", node_table, w, e, projection.ProjectionParameters())
    with pytest.raises(ValueError, match="out of range"):
        projection.ProjectionParameters(coherence_threshold=2)


def test_layout_is_deterministic(spark):
    names, links = ["a", "b", "c"], [("a", "b", 0.9), ("b", "c", 0.0)]
    first = layout.force_layout(names, links, 7)
    assert first == layout.force_layout(names, links, 7) != layout.force_layout(names, links, 8)
    table = spark.createDataFrame([(1, n, k) for k, n in enumerate(names)], "projection_id bigint, node_id string, node_ord int")
    edges = spark.createDataFrame([(1, *x, k) for k, x in enumerate(links)], "projection_id bigint, source string, target string, weight double, edge_ord int")
    seeds = spark.createDataFrame([(1, 7)], "projection_id bigint, seed bigint")
    assert {r.node_id: (r.x, r.y, r.z) for r in layout.layout_3d(table, edges, seeds).collect()} == first
    assert one(spark, "atomic_x", layout.seed_3d(F.col("v"), F.lit(0.2), F.lit(1))) >= 0


# Chat


def test_batches_reset(spark):
    df = spark.createDataFrame([([30, 30, 10, 60, 1],)], "n array<bigint>")
    assert df.select(chat.greedy_batches(F.col("n")).alias("b")).first()["b"] == [0, 0, 1, 1, 2]


def test_chat_export(spark, tmp_path):
    say = lambda id_, role, parts, t=None: {"id": id_, "author": {"role": role}, "create_time": t, "content": {"parts": parts}}
    tree = {
        "root": {"parent": None, "children": ["u", "s"], "message": None},
        "u": {"parent": "root", "children": ["a1", "a2"], "message": say("m0", "user", ["hi"])},
        "s": {"parent": "root", "children": ["a3"], "message": say("m1", "system", ["sys"])},
        "a1": {"parent": "u", "children": ["a4"], "message": say("m2", "assistant", ["one", "", "two"], 0)},
        "a2": {"parent": "u", "children": [], "message": say(None, "assistant", [" three "], "2024-01-01")},
        "a3": {"parent": "s", "children": [], "message": say("m3", "assistant", ["four"])},
        "a4": {"parent": "a1", "children": [], "message": say("m4", "assistant", [])},
    }
    (tmp_path / "chat.json").write_text(json.dumps([{"id": "", "conversation_id": "c1", "title": "t", "mapping": tree}]))
    rows = tables.walk_messages(tables.read_chat(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r.conversation_id, r.message_id, r.ts, r.text) for r in rows] == [("c1", "m2", "1970-01-01T00:00:00", "one\ntwo"), ("c1", "a2", "2024-01-01", "three"), ("c1", "m3", None, "four")]


def test_bad_exports_are_named_and_circles_end(spark, tmp_path):
    say = lambda id_: {"id": id_, "author": {"role": "assistant"}, "create_time": None, "content": {"parts": [id_]}}
    tree = {"r": {"parent": None, "children": ["a", "b"], "message": None}, "a": {"parent": "r", "children": ["b"], "message": say("a")}, "b": {"parent": "a", "children": ["a", "b"], "message": say("b")}}
    (tmp_path / "good.json").write_text(json.dumps({"id": "c", "title": "t", "mapping": tree}))
    (tmp_path / "bad.json").write_text('{"id": "c", "mapping": {')
    assert [r.message_id for r in tables.walk_messages(tables.read_chat(spark, str(tmp_path))).orderBy("ord").collect()] == ["a", "b"]
    bad = tables.bad_chat_files(spark, str(tmp_path)).collect()
    assert [r.source_file.rsplit("/", 1)[1] for r in bad] == ["bad.json"] and bad[0].n_bytes > 0


# Pipeline, sinks, stream

DOCS = [(1, "f1", "Neural networks learn patterns quickly. Neural networks learn patterns quickly. It fails here badly. Gradient descent requires patterns data"), (2, "f2", "Neural networks learn patterns quickly. Databases store records on disks")]
DOC_SCHEMA = "doc_id bigint, source_file string, text string"


def test_ingest_and_round_trip(spark, tmp_path):
    out = ingest(spark.createDataFrame(DOCS, DOC_SCHEMA))
    atomic = out.nodes.where("node_type = 'atomic'")
    assert sorted(r.statement for r in atomic.collect()) == ["Databases store records on disks", "Gradient descent requires patterns data", "Neural networks learn patterns quickly"]
    assert out.nodes.where("node_type = 'context'").count() == 2
    assert [r.reason for r in out.candidates.collect()] == ["Statement starts with dependency pronoun 'it'"]
    kinds = collections.Counter(r.type for r in out.edges.collect())
    assert kinds["appears_in"] == 3 and kinds["depends_on"] == 1
    tables.write_truth(out, str(tmp_path), single_document=True)
    again = tables.read_truth(spark, f"{tmp_path}/document")
    assert again.nodes.count() == 5 and again.edges.count() == 4
    none = graph.delta(out, out)
    assert none.nodes.count() == none.edges.count() == none.weights.count() == 0 and none.candidates.count() == 1
    assert json.loads(tables.graph_state(out).first()["value"])["atomic_nodes"]


def test_evidence_names_the_context(spark):
    out = ingest(spark.createDataFrame(DOCS, DOC_SCHEMA))
    contexts = {r.node_id for r in out.nodes.where("node_type = 'context'").collect()}
    found = [r.evidence[0] for table in (out.nodes.where("node_type = 'atomic'"), out.edges, out.candidates) for r in table.collect()]
    assert found and all(e.source in contexts and e.span is not None for e in found)
    assert [r.record_id for r in out.provenance.orderBy("record_id").collect()] == ["prov_000000", "prov_000001"]


def test_near_duplicates_across_documents(spark):
    docs = [(1, "f1", "Neural networks learn hidden patterns from training data quickly. Databases store many records on disks"), (2, "f2", "Neural networks learn hidden patterns from training data slowly. Compilers translate programs into machine code")]
    df = spark.createDataFrame(docs, DOC_SCHEMA)
    said = lambda out: sorted(r.statement for r in out.nodes.where("node_type = 'atomic'").collect())
    alone, whole = said(ingest(df)), said(ingest(df, scope="corpus"))
    assert len(alone) == 4 and len(whole) == 3 and "Neural networks learn hidden patterns from training data quickly" in whole
    first = ingest(df.where("doc_id = 1"), scope="corpus")
    known = first.nodes.where("node_type = 'atomic'").select("node_id", "statement")
    assert said(ingest(df.where("doc_id = 2"), known, scope="corpus")) == ["Compilers translate programs into machine code"]
    with pytest.raises(ValueError, match="no such scope"):
        ingest(df, scope="all")


def test_reload_names_faults(spark):
    nodes = spark.createDataFrame([("a", "2024-01-01T00:00:00"), ("b", "yesterday"), ("c", None)], "node_id string, created_at string")
    edges = spark.createDataFrame([("a", "b", "refines"), ("a", "x", "refines")], "source string, target string, type string")
    none = nodes.limit(0)
    found = tables.truth_faults(graph.TruthDelta(nodes, edges, edges.where("target = 'b'"), none, none)).collect()
    assert sorted(map(tuple, found)) == [("edges", "a x", "end"), ("nodes", "b", "time")]


def test_texts_fall_back_to_latin_1(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("schön".encode())
    (tmp_path / "b.txt").write_bytes("schön".encode("latin-1"))
    assert [r.text for r in tables.read_texts(spark, str(tmp_path)).collect()] == ["schön", "schön"]


def test_rows_numbered_over_partitions(spark):
    from veritloom.plans.lineage import numbered

    rows = numbered(spark.range(1000).selectExpr("(id * 7919) % 1000 as x").repartition(7), "seq", "x").collect()
    assert all(r.seq == r.x for r in rows) and len(rows) == 1000
    assert numbered(spark.range(0), "seq", "id").count() == 0


def test_stream_knows_earlier_batches(spark, tmp_path):
    source = tmp_path / "in"
    df = spark.createDataFrame(DOCS, DOC_SCHEMA)
    for k in (1, 2):
        df.where(f"doc_id = {k}").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(DOC_SCHEMA).parquet(str(source))
        stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    found = spark.read.parquet(f"{tmp_path}/out/nodes").where("node_type = 'atomic'")
    assert found.count() == 3 and found.select("batch_id").distinct().count() == 2


def test_a_long_text_is_split_in_time_that_grows_with_its_length(spark):
    import time

    n = 15_000
    # \E and characters beyond the first plane: literal patterns and code points
    pieces = [f"Sentence {k} names item {k * 7919} and \\E\U0001f600 ends" for k in range(n)]
    text = " \u2003" + "! ".join(pieces) + "!\u00a0"
    began = time.time()
    rows = spark.createDataFrame([(text,)], "text string").select(F.posexplode(extract.sentences(F.col("text")))).select("pos", "col.*").orderBy("pos").collect()
    assert time.time() - began < 60
    assert len(rows) == n
    at = 2
    for r, piece in zip(rows, pieces, strict=True):
        piece = piece + "!" if r["pos"] == n - 1 else piece
        assert (r["text"], r["start"], r["end"]) == (piece, at, at + len(piece))
        assert r["context"] == text[max(at - 100, 0) : at + len(piece) + 100]
        at += len(piece) + 2


def test_bullets_begin_where_their_line_first_occurs(spark):
    content = "x - again and again \\E one\n- again and again \\E one\n- another \\Q line of text"
    assert [(a, b) for _, a, b in units_of(spark, content, extract.bullets)] == [(2, 26), (52, len(content))]


def test_strip_takes_what_the_pattern_took(spark):
    odd = [chr(c) + "a" + chr(c) for c in [*range(1, 0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]] + ["", " ", "\n\n", "a b\r\n", "\u2028x\u2029"]
    both = spark.createDataFrame([(x,) for x in odd], "x string").select(T.strip(F.col("x")).alias("new"), F.regexp_replace("x", r"(?U)^\s+|\s+$", "").alias("old")).collect()
    assert [r["new"] for r in both] == [r["old"] for r in both]


def brute_best(rows, k):
    """(i, j) -> sim of the pairs that are among either's k best; rows: ord -> words."""
    from collections import Counter

    v = {o: Counter(w.split()) for o, w in rows.items()}
    size = {o: math.sqrt(sum(n * n for n in x.values())) for o, x in v.items()}

    def sim(a, b):
        whole = size[a] * size[b]
        return min(1.0, sum(n * v[b][w] for w, n in v[a].items()) / whole) if whole else 0.0

    out = {}
    for a in v:
        for s, b in sorted(((-sim(a, b), b) for b in v if b != a))[:k]:
            out[min(a, b), max(a, b)] = -s
    return out


@pytest.mark.parametrize("most", [4096, 7])
def test_best_pairs_of_a_scope_in_one_block_or_several(spark, monkeypatch, most):
    from veritloom.operators import blocks

    monkeypatch.setattr(blocks, "STATEMENTS", most)
    monkeypatch.setattr(blocks, "MOST", 64)  # several tiles of rows and of columns
    rng = random.Random(5)
    pool = [f"word{k}" for k in range(12)]
    scopes = {s: {o: " ".join(rng.choices(pool, k=rng.randrange(0, 6))) for o in range(n)} for s, n in ((1, 1), (2, 3), (3, 40), (4, 9))}
    rows = [(s, o, w, f"n{s}_{o}") for s, x in scopes.items() for o, w in x.items()]
    units = spark.createDataFrame([*rows, (3, None, "word1", "none"), (None, 1, "word1", "none")], "scope bigint, ord bigint, text string, node_id string")
    want = {(s, i, j): sim for s, x in scopes.items() for (i, j), sim in brute_best(x, 3).items()}
    got = similarity.topk_similarity(units, 3).collect()
    assert len(got) == len(want) and {(r["scope"], r["i"], r["j"]): r["sim"] for r in got} == want
    edges = similarity.similarity_edges(units, 3).collect()
    assert {(r["source"], r["target"]): r["weight"] for r in edges} == {(f"n{s}_{i}", f"n{s}_{j}"): x for (s, i, j), x in want.items()} and len(edges) == len(want)
    every = {(s, i, j): sim for s, x in scopes.items() for (i, j), sim in brute_best(x, 99).items() if sim >= 0.5}
    close = similarity.pairwise_threshold(units, 0.5).collect()
    assert len(close) == len(every) and {(r["scope"], r["i"], r["j"]): pytest.approx(r["sim"]) for r in close} == every


def test_best_pairs_are_not_shuffled(spark):
    units = spark.createDataFrame([(1, k, f"same word here {k}", f"n{k}") for k in range(50)], "scope bigint, ord bigint, text string, node_id string")
    plan = similarity.topk_similarity(units, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
