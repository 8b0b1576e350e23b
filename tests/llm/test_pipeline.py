"""The pipeline against a plain version, on awkward tables, and beside other work."""

import collections
import hashlib
import math
import os
import re
import zlib
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pytest
from roadspark.llm import common, exact_dedup, quality, simhash, tokens, wide_simhash

SMALL = "/root/testdata/sf0.001"
EXTRA = ["row", "score", "sha", "key", "place", "node", "size", "taken", "print", "serial"]


def plain_pipeline(docs, network):
    """(doc_id, text) of documents in the order of stages, and how often each is taken: nothing but definitions."""
    docs = [(i, t, s) for i, t, s in docs if network.score([(t or "").encode()])[0] >= quality.THRESHOLD]
    last = {}
    for i, t, s in sorted(docs, key=lambda d: d[0]):
        last[t or ""] = (i, t, s)
    docs = list(last.values())
    sets = []
    for _, t, _ in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    group = list(range(len(docs)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group[max(root(a), root(b))] = min(root(a), root(b))
    kept = collections.defaultdict(list)
    for k, d in enumerate(docs):
        kept[root(k)].append(d)
    docs = [min(g) for g in kept.values()]
    # The mixture: water-filling by repeated capping, whole epochs, then keys.
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sources)}
    full, level = set(), 0.0
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        level = left / sum(weight[s] for s in sources if s not in full) if len(full) < len(sources) else math.inf
        more = {s for s in sources if s not in full and weight[s] * level > 3 * total[s]}
        if not more:
            break
        full |= more
    out = []
    for s in sources:
        quota = int(min(3 * total[s], weight[s] * level))
        epochs = quota // total[s] if total[s] else 0
        rest = quota - epochs * total[s]
        keys = []
        for i, t, x in docs:
            if x == s:
                tie = hashlib.md5(f"mix-1|{i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
                good = 0.5 if t is None else 1 / (1 + min(abs((len(t) + 1) / (size[i] + 1) - 7) / 7, 1))
                keys.append((-math.log((int(tie[:12], 16) + 0.5) / 16**12) / good, tie, size[i], i, t))
        for _, _, n, i, t in sorted(keys, key=lambda k: k[:3]):
            more = min(n, rest)
            rest -= more
            out.append((i, t, 1 if n == 0 else int((epochs * n + more) / n + 0.5)))
    return out


def test_run_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    network = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {i: (t, n) for i, t, n in plain_pipeline([(r.doc_id, r.text, r.source) for r in docs.collect()], network) if n}
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokens.default_path())
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(want)
    for i, (t, n) in want.items():
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert sum(r.length for r in got[i]) == n * len(ids)
        assert all(r.doc_tokens == len(ids) and bytes(r.ids) == ids[r.start : r.start + r.length].tobytes() and r.ids_crc32 == zlib.crc32(r.ids) for r in got[i])


def awkward(spark, folder, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], kind).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


PROSE = " ".join(f"word{k * k % 97}" for k in range(300))
LONG = " ".join(f"w{k}" for k in range(400_000))  # some MB
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "no id", None, "b", 5), (None, None, "en", None, 0), (3, PROSE, "en", "a", 1), (4, PROSE, "en", None, 1),
    (5, PROSE + " end", "en", "b", 1), (5, PROSE + " end", "en", "b", 1), (6, "   ", "en", "c", 3), (7, "x", "en", "c", 1), (8, "X", "en", "c", 1), (9, LONG, "en", "a", 1), (10, "é日本 ñ " * 40, "en", "d", 1),
]


def test_stages_on_awkward_rows(spark, tmp_path):
    folder = awkward(spark, str(tmp_path), AWKWARD)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(common.keep(stage(spark, kept[-1], folder), name))
        assert kept[-1].columns == columns, name
    score = {r.row.text: r.score for r in quality.score(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    good = [r for r in AWKWARD if score[r[1]] >= quality.THRESHOLD]
    assert kept[1].count() == len(good)
    assert kept[2].count() == len({r[1] or "" for r in good})
    words = {" ".join((r[1] or "").lower().split()) for r in good} - {PROSE + " end"} if any(r[1] == PROSE for r in good) else {" ".join((r[1] or "").lower().split()) for r in good}
    assert kept[3].count() == len(words)
    assert corpus_pipeline.STAGES[-1][1](spark, kept[4], folder).filter("length < 1 or offset < 0").count() == 0
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    """Also those of the last stage, which is computed when its result is read; a smaller number that is set already stays."""
    folder = awkward(spark, str(tmp_path), AWKWARD)
    before = spark.conf.get(corpus_pipeline.BATCH)
    try:
        for asked, used in ((10_000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (50, 50)):
            spark.conf.set(corpus_pipeline.BATCH, str(asked))
            corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert int(spark.conf.get(corpus_pipeline.BATCH)) == used
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)


def test_empty_tables(spark, tmp_path):
    folder = awkward(spark, str(tmp_path), [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_near_copies_of_repeated_rows_and_ties(spark):
    data = [(1, PROSE), (1, PROSE), (1, PROSE.upper()), (None, PROSE + " more"), (2, PROSE + " tail"), (None, None), (None, ""), (None, "alone here")]
    got = wide_simhash.drop_near(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, (r.text or "")[:5].lower()) for r in got) == [(-1, ""), (-1, "alone"), (1, PROSE[:5])]


def folders(spark):
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {p for p in os.listdir(at) if p.startswith("run-")} if os.path.isdir(at) else set()


def test_a_run_leaves_other_results_alone_and_no_folder(spark, tmp_path):
    pending = simhash.query(spark, SMALL)
    held = exact_dedup.drop_copies(spark.read.parquet(f"{SMALL}/documents.parquet"))
    before = folders(spark)
    with common.workspace(spark):
        corpus_pipeline.run(spark, SMALL).write.parquet(str(tmp_path / "out"))
        assert folders(spark) > before
    assert folders(spark) == before
    assert pending.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count() and held.count() > 0


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]", "yarn"])
def test_a_cluster_needs_a_shared_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="share"):
        common.Workspace(session)
