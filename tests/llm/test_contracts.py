"""Every registered query and every stage of the pipeline against plain Python, on the smallest tables."""

import hashlib
import re
import zlib
from urllib.parse import urlsplit

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tasklens.llm import common, quality, queries
from tests.llm.test_llm import shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def result(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def words(t):
    """A-Z lower-cased; parted by space and \\x09-\\x0D alone."""
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t)) if w]


def groups(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def shingle_set(t, k=5):
    w = words(t)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def library_ids(name, end, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: np.array(tok.encode(t, add_special_tokens=False).ids + [end], "<u4") for i, t in texts.items()}


def test_every_query_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(queries.SQL) <= set(queries.QUERIES)


def test_op1(spark, texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = groups(sets, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in result(spark, "op1_near_duplicates")} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_op2(spark, texts):
    got = {r.doc_id: r for r in result(spark, "op2_fingerprints")}
    order = sorted(texts, reverse=True)
    assert set(got) == set(order)
    prints = {}
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()) and 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        assert prints.setdefault(t, g.fingerprint) == g.fingerprint
    long = [g for i, g in got.items() if len(texts[i]) > 400]
    assert np.mean([g.near_edited for g in long]) > np.mean([g.near_next for g in long]) + 0.3


def test_op3(spark, texts):
    ids = library_ids("word_bpe_49k.json", 1, texts)
    got, start = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in result(spark, "op3_token_files")}, 0
    for i in sorted(ids):
        assert got.pop(i) == (start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    assert not got


def test_op4(spark):
    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = result(spark, "op4_main_text")
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        page = pages[r.page_id]["html"] or ""
        article = re.search(r"<article>(.*?)</article>", page, re.S)
        assert r.url == pages[r.page_id]["url"] and r.n_chars == len(r.text)
        if article:
            import html

            blocks = re.split(r"</?(?:h1|p)>", article[1])
            plain = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)))).strip() for b in blocks]
            assert r.text == "\n".join(b for b in plain if b)


@pytest.mark.parametrize("name, label, cut, least", [("op5_toxicity", "toxic", 0.5, 0.85), ("op9_quality", "quality", 0.3, 0.9)])
def test_op5_and_op9(spark, texts, name, label, cut, least):
    got = {r.doc_id: r for r in result(spark, name)}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    seen = [(r[label], got[r["doc_id"]].predicted) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r[label] is not None and r["doc_id"] in got]
    assert np.mean([a == b for a, b in seen]) >= least


def base_spans(t):
    """The three base patterns, found by hand: leftmost, not overlapping in each kind."""
    out = []
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low, at = "".join(c.lower() if c.isascii() else c for c in t), 0
    keys = ("password", "passwd", "secret", "token", "api_key", "apikey")
    while at < len(t):
        key = next((k for k in keys if low.startswith(k, at)), None)
        if key is None:
            at += 1
            continue
        p = at + len(key)
        p += t[p : p + 1] in ('"', "'") and p < len(t)
        while t[p : p + 1] == " ":
            p += 1
        if t[p : p + 1] in (":", "=") and p < len(t):
            p += 1
            while t[p : p + 1] == " ":
                p += 1
            p += t[p : p + 1] in ('"', "'") and p < len(t)
            end = p
            while end < len(t) and t[end] in value:
                end += 1
            if end > p:
                if end - p >= 8:
                    out.append((at, 0, end))
                at = end
                continue
        at += 1
    for kind, start, letters, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), (2, "", set("0123456789abcdef"), 32)):
        at = 0
        while at < len(t):
            end = at
            if t.startswith(start, at):
                end = at + len(start)
                while end < len(t) and t[end] in letters:
                    end += 1
                if end - at >= least and end > at + len(start):
                    out.append((at, kind, end))
            at = max(at + 1, end)
    return sorted(out)


def test_op6(spark, texts):
    kinds = ("assign", "access", "hex")
    for r in result(spark, "op6_secrets"):
        base = base_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        joined = [f"{kinds[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r.spans.split(","))


def test_op7(spark):
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    for r in result(spark, "op7_url_decisions"):
        u = urlsplit(pages[r.page_id]["url"])
        fits = [(len(h + p), h + p, k) for k, h, p in rules if (u.netloc.lower() == h or u.netloc.lower().endswith("." + h)) and u.path.startswith(p)]
        _, rule, kind = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (u.netloc.lower(), u.path, rule, kind)


def check_pieces(pieces, ids):
    done, at = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == done.get(p.doc_id, 0) and p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        done[p.doc_id] = p.start + p.length
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : done[p.doc_id]].tobytes())
    assert done == {i: len(x) for i, x in ids.items()}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at.get(p.sequence_id, 0)
        at[p.sequence_id] = p.offset + p.length
    assert sorted(at) == list(range(len(at))) and all(n == 1024 for k, n in at.items() if k < len(at) - 1)


def test_op8(spark, texts):
    check_pieces(result(spark, "op8_packing"), library_ids("byte_bpe_50k.json", 0, texts))


def leaking(texts):
    items = [shingle_set(r["text"] or "") for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    out = set()
    for i, t in texts.items():
        w = words(t)
        for q in items:
            k = len(next(iter(q))) if q else 0
            if q and 100 * len(q & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}) >= 80 * len(q):
                out.add(i)
    return out


def test_op10(spark, texts):
    assert {r.doc_id for r in result(spark, "op10_contamination")} == leaking(texts) != set()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    columns = sorted(c[0] for c in want.description)
    want = sorted((tuple(r[k] for k in sorted(range(len(r)), key=lambda k: want.description[k][0])) for r in want.fetchall()), key=str)
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()) == want or sorted((tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()), key=str) == want


def test_pipeline_stages(spark, texts, tmp_path):
    """Each stage on what the one before it kept, against plain Python."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / str(len(seen)))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicate removal", "benchmark decontamination", "secret scan", "packing"]
    assert all(list(rows[0].asDict()) == columns for rows in seen[:4])
    good, distinct, clean, masked, packed = seen

    every = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(every, spark.read.parquet(f"{SF}/labels.parquet"))
    stats = np.array([quality.statistics(texts[i]) for i in sorted(texts)])
    z = np.cos(np.clip((stats - model.mean) / model.scale, -6, 6) @ model.w + model.b) * np.sqrt(2 / quality.FEATURES)
    raw = z @ model.beta[:-1] + model.beta[-1]
    score = 0.98 * np.interp(raw, model.xs, model.ys) + 0.02 * np.clip(raw, 0, 1)
    assert {r.doc_id for r in good} == {i for i, s in zip(sorted(texts), score) if s >= 0.3}
    root = groups({r.doc_id: shingle_set(texts[r.doc_id]) for r in good}, 80)
    assert {r.doc_id for r in distinct} == {i for i, x in root.items() if i == x}
    assert {r.doc_id for r in clean} == {r.doc_id for r in distinct} - leaking(texts)
    assert {r.doc_id for r in masked} == {r.doc_id for r in clean}
    for r in masked:
        assert not [s for s in base_spans(r.text) if "[SECRET]" not in r.text[s[0] : s[2]]] and r.n_chars == len(r.text)
        if not base_spans(texts[r.doc_id]) and "[SECRET]" not in r.text:
            assert r.text == texts[r.doc_id]
    check_pieces(packed, library_ids("byte_bpe_50k.json", 0, {r.doc_id: r.text for r in masked}))


def test_scratch_folder_must_be_shared(spark, monkeypatch):
    monkeypatch.setattr(common, "_scratch", {})
    path = common.scratch_dir(spark)
    assert path == common.scratch_dir(spark) and path.endswith(spark.sparkContext.applicationId)


def test_shingles_agree(texts):
    assert all({" ".join(x) for x in shingles(t)} == {" ".join(x) for x in shingle_set(t)} for t in texts.values() if t.isascii())


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.7, (40, quality.N_STATS))
    model = quality.Model(np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    z = model.features(x)[:, :-1]
    exact = np.exp(-quality.GAMMA * ((x[:, None] - x) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).mean() < 0.06


def test_normal_equations_match_one_process(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = common.labelled_sample(docs, labels, "quality", 10**6).orderBy("doc_id").collect()
    x, y = np.array([quality.statistics(r.text) for r in rows]), np.array([r.y for r in rows], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-3, atol=1e-6)
    z = model.features(x)
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ beta, z @ model.beta, atol=1e-4)


def test_isotonic_matches_its_definition():
    rng = np.random.default_rng(4)
    score, y = np.round(rng.random(60), 1), rng.integers(0, 2, 60).astype(float)
    points = np.unique(score)
    mean = lambda a, b: y[(score >= a) & (score <= b)].mean()
    want = [max(min(mean(a, b) for b in points[points >= p]) for a in points[points <= p]) for p in points]
    xs, ys = quality.isotonic(score, y)
    assert np.allclose(sorted(set(np.round(want, 9))), np.round(ys, 9)) and (np.diff(xs) > 0).all()
