"""The stages against brute force on small tables: planted rows, repeated and missing ids, clashing columns, long texts."""

import base64
import hashlib
import os
import random
import re
import sys

import numpy as np
import tiktoken

import corpus_pipeline
from siftline.llm import langid, mixing, queries, runtime, secretscan

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import brute_components, naive_language  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = COLUMNS + ", of long, copies long, lang_pred string, lang_cover double, row string, key long, size long"


def planted():
    """Rows of four invented languages with copies, near copies, secrets, repeated and missing ids, odd texts."""
    rng = random.Random(31)
    alphabets = {"aa": "mopstu", "bb": "defghi", "cc": "wxyzkl", "dd": "rnbcvq"}
    word = lambda k: "".join(rng.choice(alphabets[k]) for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(120):
        lang = rng.choice(sorted(alphabets))
        rows.append([i, " ".join(word(lang) for _ in range(rng.randint(40, 90))), lang, f"s{i % 3}"])
    for i in range(40):
        d, text, lang, source = rng.choice(rows[:60])
        words = text.split()
        if i % 2:
            words[rng.randrange(len(words))] = "zz"
        rows.append([rng.choice([200 + i, None, d, d]), " ".join(words), lang, source])
    secret = hashlib.sha1(b"k").hexdigest()
    rows += [[300, rows[3][1] + f' token = "{secret}" end', "aa", None], [301, None, "aa", "s1"], [302, "12 34 !!", "bb", "s1"], [None, "", None, "s1"], [303, " ".join(word("aa") for _ in range(30000)), "aa", "s2"], rows[7][:], rows[7][:]]
    return [tuple(r) for r in rows], secret


def test_stages_equal_brute_force(spark):
    """Each stage on its own input, with every clashing column."""
    rows, secret = planted()
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "p", 0.5, "r", 3, 4) for r in rows], CLASHES).repartition(3)
    stages, ids = dict(corpus_pipeline.STAGES), lambda x: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in x)

    out = stages["language ID"](spark, docs, SF)
    assert out.columns == docs.columns
    known = [(r[2], r[1].encode()) for r in rows if r[1] is not None and r[2] is not None]
    want = []
    for r in docs.collect():
        counts, n = naive_language(known, (r.text or "").encode()) if len(r.text or "") < 5000 else ({"": 1.0}, 1)
        if re.search(r"[^\W\d_]", r.text or "") and max(counts.values()) / max(1, n) >= langid.LEAST_COVER:
            want.append(r)
    assert ids(out.collect()) == ids(want) and len(want) == len(rows) - 3

    kept = stages["n-gram Jaccard join"](spark, out, SF)
    assert kept.columns == docs.columns
    held = out.collect()
    # components by row, then the least id of each, rows without one last
    component = {i: c for i, _, c in brute_components([(i, r.text) for i, r in enumerate(held)])}
    first = {}
    for i, r in enumerate(held):
        place = (r.doc_id is None, r.doc_id or 0)
        first[component[i]] = min(place, first.get(component[i], place))
    got = kept.collect()
    assert len(got) == len(first)
    texts = {}
    for i, r in enumerate(held):
        texts.setdefault((r.doc_id is None, r.doc_id or 0, r.text), component[i])
    assert {texts[r.doc_id is None, r.doc_id or 0, r.text]: (r.doc_id is None, r.doc_id or 0) for r in got} == first

    red = stages["secret scans"](spark, kept, SF)
    forest = secretscan.train(secretscan.labelled_findings())
    want = []
    for r in got:
        text = r.text
        for a, b, s in reversed(secretscan.judge(text, r.source or "", forest)):
            text = text[:a] + "<SECRET>" + text[b:] if s >= secretscan.LEAST_SCORE else text
        want.append((r.doc_id is None, r.doc_id or 0, text))
    assert red.columns == docs.columns and ids(red.collect()) == sorted(want) and not [t for *_, t in want if secret in t]

    mixed = stages["mixing"](spark, red, SF)
    copies = {}
    for r in mixing.mix(red).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert mixed.columns == docs.columns and counts == {d: n for d, n in copies.items() if n}
    sizes = {}
    for r in red.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in mixing.mix(red).select("source", "source_size").distinct().collect():
        assert r.source_size == sizes[r.source]

    path, pattern = queries.vocabulary()
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    coded = stages["byte-level BPE"](spark, mixed, SF)
    got = sorted((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded_sha256) for r in coded.collect() if r.doc_id is not None)
    want = []
    for r in mixed.collect():
        if r.doc_id is not None:
            e = enc.encode_ordinary(r.text)
            want.append((r.doc_id, np.array(e, "<u4").tobytes(), len(e), hashlib.sha256(r.text.encode()).hexdigest()))
    assert got == sorted(want)


def test_run_and_empty_table(spark, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_python_worker_a_task(spark):
    """Every running task keeps a Python worker (some 100 MB) for each Python step of its plan, and idle ones stay for the next task."""
    held = []

    def steps(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return steps(node.initialPlan())
        below = max((steps(node.children().apply(i)) for i in range(node.children().size())), default=0)
        held.append(own := below + ("Arrow" in node.nodeName() or "Python" in node.nodeName()))
        return 0 if "Exchange" in node.nodeName() else own

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (dict(corpus_pipeline.STAGES)["byte-level BPE"](spark, docs, SF), queries.op7_bpe(spark, SF)):
        steps(df._jdf.queryExecution().executedPlan())
    assert max(held) == 1
    table = secretscan.labelled_table(spark, 50)
    assert [tuple(r) for r in table.collect()] == secretscan.labelled_findings(50) and "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_gather_no_table_on_the_driver(spark):
    """No write of the stage broadcasts a table, and all run in the same clone of the session."""
    rows, _ = planted()
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsList().size()
    corpus_pipeline.near_duplicates(spark, docs, SF)
    bus.waitUntilEmpty(30_000)
    after = store.executionsList()
    plans = [after.apply(i).physicalPlanDescription() for i in range(before, after.size())]
    assert sum("Join" in x for x in plans) > 3 and not [x for x in plans if "BroadcastExchange" in x]
    one = runtime.writer(spark, shuffled=True)
    assert runtime.writer(spark, shuffled=True).equals(one) and not runtime.writer(spark).equals(one)


def test_writer_follows_the_session(spark):
    """Settings that the session gets or loses after its first write hold in the next; those of the writes don't reach it."""
    key = "spark.sql.shuffle.partitions"
    was, none = spark.conf.get(key), "spark.sql.siftline.test"
    try:
        for value in ("3", "5"):
            spark.conf.set(key, value)
            spark.conf.set(none, value)
            assert {runtime.writer(spark, x).conf().get(y) for x in (True, False) for y in (key, none)} == {value}
        spark.conf.unset(none)
        assert runtime.writer(spark).conf().get(none, "gone") == runtime.writer(spark, True).conf().get(none, "gone") == "gone"
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1" and runtime.writer(spark).conf().get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    finally:
        spark.conf.set(key, was)
        spark.conf.unset(none)
