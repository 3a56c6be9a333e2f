"""Exact dedup, WARC, Jaccard join, language model, nearest neighbours and the pipeline, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from strandset.llm import ann, components, dedup, lm, ngram_join, queries, warc
from strandset.llm.common import materialize
from strandset.llm.words import word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """rows: (doc_id, text); two more columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], FIELDS).withColumn("file", F.lit("x")).withColumn("digest", F.lit(1))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def copies(seed=2, n=120):
    rng = random.Random(seed)
    base = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=rng.randint(0, 30))) for _ in range(20)]
    rows = [(i, re.sub(" ", lambda m: rng.choice([" ", "  ", "\n", "\t"]), rng.choice(base))) for i in range(n)]
    return rows + [(500, None), (501, ""), (502, " \x0b\x0c"), (None, "alpha"), (503, "alpha"), (503, "alpha"), (504, "x" * 50000), (505, "\xa0")]


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), hashlib.sha256(body.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [dedup.sha256, lambda c: F.substring(dedup.sha256(c), 1, 1)], ids=["sha256", "collisions"])
@pytest.mark.parametrize("files", [None, 1])
def test_exact_groups(spark, tmp_path, digest, files):
    rows = copies()
    path = str(tmp_path / "docs")
    documents(spark, rows).repartition(5).write.parquet(path)
    got = dedup.exact_groups(spark.read.parquet(path), digest=digest, files_per_batch=files).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == exact(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})


def test_deduplicate_tables_without_files(spark):
    rows = copies(3, 40)
    df = documents(spark, rows)
    got = dedup.deduplicate(df)
    assert got.columns == df.columns and got.count() == len({x[3] for x in exact(rows)})
    assert dedup.deduplicate(df.limit(0)).count() == 0 and dedup.exact_groups(df.limit(0)).count() == 0


def test_state_survives_a_restart(spark, tmp_path):
    schema = "doc_id bigint, size bigint, digest string, file string, row bigint"
    source, checkpoint, out = (str(tmp_path / x) for x in ("in", "cp", "out"))
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    add([(2, 5, "a", "f", 0), (3, 5, "b", "f", 1)])
    dedup.stream_groups(spark, source, schema, checkpoint, out).count()
    add([(1, 5, "a", "g", 0), (4, 9, "b", "g", 1)])
    found = {r.digest: (r.best.doc_id, r.copies) for r in dedup.stream_groups(spark, source, schema, checkpoint, out).collect()}
    assert found == {"a": (1, 2), "b": (4, 2)}


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id bigint, url string, html string, payload int")


def test_warc_round_trip(spark):
    big, other = "<p>é" * 400, "x" * 999
    rows = [(1, "http://a/ü?q=1", big), (2, None, big), (3, "http://b\r\nInjected: x", other), (4, "u", other), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "solo" * 300), (8, "u", "dup" * 400), (8, "u", "dup" * 400), (9, "u", "WARC/1.1\r\n\r\n" * 90000)]
    got = sorted([tuple(r) for r in warc.warc_round_trip(pages(spark, rows)).collect()], key=str)
    top = {}
    for i, _, h in rows:
        top[h] = max(top.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= 1000 and (i is None or i < top[h])
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top[h] if again else None))
    assert got == sorted(want, key=str)
    assert warc.warc_round_trip(pages(spark, rows).limit(0)).count() == 0


def test_warc_general_reader(spark, tmp_path):
    out = str(tmp_path / "archive")
    warc.write_warc(pages(spark, [(i, f"http://x/{i}", f"text of page {i} " * 50) for i in range(300)]).coalesce(1), out)
    rows = warc.read_warc(spark, out, glob="part-*").collect()
    assert {bytes(r.payload).decode() for r in rows} == {f"text of page {i} " * 50 for i in range(300)}
    content = open(next((tmp_path / "archive").glob("part-*")), "rb").read()
    kinds = [m for m, _, _ in warc.frames(content)]
    assert kinds[0] == warc.DICTIONARY and kinds.count(warc.FRAME) == 300


def test_warc_damage():
    record = warc.make_record(1, "u", b"payload", None, "2000-01-01T00:00:00Z")
    assert warc.parse_record(record)["payload"] == b"payload"
    for bad in (record[:-1], record.replace(b"payload", b"payloae"), record.replace(b"WARC-Date", b"X-Date"), b"junk", record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    frame = zstandard.ZstdCompressor(write_content_size=True).compress(record)
    assert [r for _, r in warc.read_records(frame)] == [record]
    for bad in (frame[:-3], frame + b"junkjunk", b"\0" * 20):
        with pytest.raises(ValueError):
            list(warc.read_records(bad))
    packed = zstandard.ZstdCompressor().compress(b"not used by any frame, but compressed itself")
    lead = (0x184D2A5D).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed
    assert [r for _, r in warc.read_records(lead + frame)] == [record]


def near_copies(seed, n=90, length=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [rng.choices(vocabulary, k=rng.choice([3, 8, 12, 20, length])) for _ in range(12)]
    passage = rng.choices(vocabulary, k=20)
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            text += passage
        rows.append((i, " ".join(text).upper() if rng.random() < 0.1 else " ".join(text)))
    return rows + [(200, None), (201, ""), (202, "only two"), (203, "Only\ttwo"), (204, "one"), (205, "b " * 3000), (206, "b " * 2000), (206, "b " * 2000), (None, rows[0][1])]


def joined(rows, n, a, b):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            overlap = len(sets[i] & sets[j])
            if sets[i] and sets[j] and b * overlap >= a * (len(sets[i]) + len(sets[j]) - overlap):
                parent[find(i)] = find(j)
    smallest: dict = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), (True, 0)), (d is None, d or 0))
    named = {k: None if none else d for k, (none, d) in smallest.items()}
    return sorted([(d, len(sets[i]), named[find(i)]) for i, (d, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("n, a", [(3, 90), (3, 60), (5, 80), (1, 50)])
def test_jaccard_components(spark, n, a):
    rows = near_copies(n * 100 + a)
    got = ngram_join.jaccard_components(documents(spark, rows).repartition(3), n, a, 100).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == joined(rows, n, a, 100)


def test_jaccard_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROWS", 4)
    rows = near_copies(7)
    got = ngram_join.jaccard_components(documents(spark, rows), 3, 60, 100).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == joined(rows, 3, 60, 100)


def test_jaccard_many_partitions(spark):
    rows = near_copies(13)
    got = ngram_join.jaccard_components(documents(spark, rows).repartition(40), 3, 60, 100).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == joined(rows, 3, 60, 100)


def test_one_of_each(spark):
    rows = near_copies(11)
    df = documents(spark, rows)
    got = ngram_join.one_of_each(df, 5, 80, 100)
    want = joined(rows, 5, 80, 100)
    alone = sum(1 for _, size, _ in want if size == 0)
    assert got.columns == df.columns and got.count() == len({c for _, size, c in want if size}) + alone
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_signatures_meet_wherever_sets_link():
    rng = np.random.default_rng(5)
    for a in (90, 80, 50):
        levels = ngram_join.Levels(a, 100)
        for _ in range(300):
            size = int(rng.integers(1, 300))
            x = rng.integers(0, 1 << 63, size, np.uint64)
            y = np.concatenate([x[int(rng.integers(0, size // 4 + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, size // 4 + 2)), np.uint64)])
            x, y = np.unique(x), np.unique(y)
            overlap = len(np.intersect1d(x, y))
            if ngram_join.linked(overlap, len(x), len(y), a, 100):
                assert len(np.intersect1d(levels.signatures(x), levels.signatures(y)))


def test_overlaps():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 50, rng.integers(1, 30)).astype(np.uint64)) for _ in range(20)]
    got = ngram_join.overlaps(rows)
    assert all(got[i, j] == len(np.intersect1d(rows[i], rows[j])) for i in range(20) for j in range(20) if i != j)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (95, 100)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 300)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("The a b C d e f g h stone river".split(), weights=range(11, 0, -1), k=rng.randint(0, 50)))) for i in range(80)]
    rows += [(90, None), (91, "unseen words here"), (91, "unseen words here"), (None, "a b")]
    token = [[*words(t), "\n"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    got = lm.corpus_scores(documents(spark, rows).repartition(3), keep=2).collect()
    assert len(got) == len(rows)
    c, pairs = Counter(), Counter()
    for t, h in zip(token, held, strict=True):
        if not h:
            c.update(t)
            pairs.update(zip(["\n", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    cc, pc = Counter(c.values()), Counter(pairs.values())
    d1, d2 = lm.discount(cc[1], cc[2]), lm.discount(pc[1], pc[2])
    kept, types = Counter(), Counter()
    for (h, _), k in pairs.items():
        if k >= 2:
            kept[h] += k
            types[h] += 1
    p1 = lambda w: max(c[w] - d1, 0) / n + d1 * v / n / (v + 1)

    def p(w, h):
        if not c[h]:
            return p1(w)
        k = pairs[h, w]
        return ((k - d2) / c[h] if k >= 2 else 0) + (1 - (kept[h] - d2 * types[h]) / c[h]) * p1(w)

    for h in [*c, "never"]:
        assert abs(sum(p(w, h) for w in c) + p("never", h) - 1) < 1e-9
    want = [(i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(w, x)) for x, w in zip(["\n", *t], t, strict=False))) for (i, _), h, t in zip(rows, held, token, strict=True)]
    key = lambda r: (str(r[0]), r[5], r[6])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-9 and abs(g[6] - w[6]) < 1e-9
    assert lm.corpus_scores(documents(spark, rows).limit(0)).count() == 0


def test_language_model_keeps_bigrams_seen_once(spark, tmp_path):
    texts = ["a b c", "a c", "c b d", "d a", "b b a", "c d", "", "a b d", "x y", "y a x b"]
    rows = list(enumerate(texts * 2))
    documents(spark, [(i, t + f" u{i} v{i % 3}") for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    token = [[*words(t + f" u{i} v{i % 3}"), "\n"] for i, t in rows]
    c, pairs = Counter(), Counter()
    for (i, _), t in zip(rows, token, strict=True):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t)
            pairs.update(zip(["\n", *t], t, strict=False))
    n, v, cc, pc = sum(c.values()), len(c), Counter(c.values()), Counter(pairs.values())
    d1, d2 = lm.discount(cc[1], cc[2]), lm.discount(pc[1], pc[2])
    types = Counter(h for h, _ in pairs)
    p1 = lambda w: max(c[w] - d1, 0) / n + d1 * v / n / (v + 1)
    p = lambda w, h: max(pairs[h, w] - d2, 0) / c[h] + d2 * types[h] / c[h] * p1(w) if c[h] else p1(w)
    got = {r.doc_id: r.score for r in queries.op7_lm_scores(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and pc[1]
    for (i, _), t in zip(rows, token, strict=True):
        assert abs(got[i] - sum(math.log10(p(w, h)) for h, w in zip(["\n", *t], t, strict=False))) < 1e-9


def test_language_model_asks_without_contexts(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randint(0, 2000)}" for _ in range(200))) for i in range(100)]
    df = documents(spark, rows).select("doc_id", F.lit(False), "text").coalesce(1)
    asked = df.mapInArrow(lm.make_blocks, lm.BLOCK_SCHEMA).mapInArrow(lambda batches: lm.asked(batches, 32), lm.ASKED)
    sent = asked.agg(*[F.sum(F.length(name)) for name, kind in asked.dtypes if kind == "binary"]).first()
    pairs = {p for _, t in rows for p in zip(["\n", *t.split()], [*t.split(), "\n"], strict=True)}
    assert sum(sent) < 8 * len(pairs)  # a hash's difference, here 6 bytes, and a packed count


def test_language_model_adds_up_contexts_across_blocks(spark):
    """Bigrams that several blocks ask for count once in what a word's bigrams sum to."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b", "c a b", "d a d", "", "b a e", "a"] * 3)]
    token = [[*words(t), "\n"] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    pairs = Counter(p for t, h in zip(token, held, strict=True) if not h for p in zip(["\n", *t], t, strict=False))
    df = documents(spark, rows)
    for keep in (1, 2, 4):
        one, each = ({r.doc_id: r.score for r in lm.corpus_scores(x, keep=keep).collect()} for x in (df.coalesce(1), df.repartition(9)))
        assert one == each and len(one) == len(rows)
    c = Counter(w for t, h in zip(token, held, strict=True) if not h for w in t)
    n, v, cc, pc = sum(c.values()), len(c), Counter(c.values()), Counter(pairs.values())
    d1, d2 = lm.discount(cc[1], cc[2]), lm.discount(pc[1], pc[2])
    p1 = lambda w: max(c[w] - d1, 0) / n + d1 * v / n / (v + 1)
    kept = lambda h: [k for (x, _), k in pairs.items() if x == h and k >= 4]
    p = lambda w, h: ((pairs[h, w] - d2) / c[h] if pairs[h, w] >= 4 else 0) + (1 - (sum(kept(h)) - d2 * len(kept(h))) / c[h] if c[h] else 1) * p1(w)
    for (i, _), t in zip(rows, token, strict=True):
        assert abs(each[i] - sum(math.log10(p(w, h)) for h, w in zip(["\n", *t], t, strict=False))) < 1e-9


def test_language_model_without_training(spark):
    got = lm.score_texts(documents(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)}


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 64)
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(600)]
    vectors += [(600 + i, vectors[3][1]) for i in range(150)]  # a hot vector
    odd = [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [1.0] * 7), (980, [None] + [1.0] * 7), (1000, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in vectors + odd], "vec_id bigint, embedding array<double>, label int, shard int")
    got = ann.nearest(df, "id % 20 = 0", k=20).collect()
    ids, points = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    found = defaultdict(dict)
    for r in got:
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(found) == {i for i, _ in vectors if i % 20 == 0}
    hits = 0
    for q, ranked in found.items():
        assert sorted(ranked) == list(range(1, 21))
        score = points @ points[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits += len({ids[i] for i in order} & {v for v, _ in ranked.values()})
        listed = [ranked[k] for k in sorted(ranked)]
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - score[v]) < 1e-9 for v, s in listed)
    assert hits >= 0.9 * 20 * len(found)
    assert ann.nearest(df.limit(0), "id % 20 = 0").count() == 0
    few = ann.nearest(df.where("vec_id < 3"), "id % 20 = 0").collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]


def test_traversal_is_in_order():
    rng = np.random.default_rng(2)
    near, far = rng.normal(size=9), rng.normal(size=7)
    counts = rng.integers(0, 3, 63)
    order = ann.traverse(near, far, counts, 10**9)
    total = (near[:, None] + far[None, :]).ravel()
    assert sorted(order) == np.flatnonzero(counts).tolist() and (np.diff(total[order]) >= 0).all()
    assert counts[ann.traverse(near, far, counts, 10)].sum() >= 10


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    vocabulary = "the river stone water house that with from and people town".split()
    texts = [" ".join(rng.choices(vocabulary, k=80)) for _ in range(30)]
    edited = [t.replace("river", "lake", 1) for t in texts[:5]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, *texts[:4], *edited, "123", ""])] + [(99, None, None, None, None)]
    folder = tmp_path / "tables"
    spark.createDataFrame(rows, FIELDS).write.parquet(str(folder / "documents.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    kept = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
        assert docs.columns == FIELDS.replace(" bigint", "").replace(" string", "").split(", ")
        kept.append({r.doc_id for r in docs.collect()})
    assert kept == [set(range(39)), {*range(30), *range(34, 39)}, set(range(30))]
    got = pipeline.run(spark, str(folder))
    assert {r.doc_id for r in got.collect()} == set(range(30))


def test_pipeline_of_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    vocabulary = "the river stone water house that with from and people town".split()
    text = " ".join(rng.choices(vocabulary, k=60))
    long = " ".join(rng.choices(vocabulary, k=60000))
    rows = [(1, text, "en"), (1, text, "en"), (None, text + " ", None), (None, None, "en"), (2, "", None), (3, long, None), (3, long + "\n", "en"), (4, "the", "en"), (5, text.replace("river", "lake", 1), "en")]
    made = "doc_id bigint, text string, lang string"
    for name, these in (("odd", rows), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(these, made).selectExpr("*", "'f' as file", "3 as row", "9 as stays", "'k' as key", "1 as start").write.parquet(folder + "/documents.parquet")
        docs = spark.read.parquet(folder + "/documents.parquet")
        columns = docs.columns
        for _, stage in pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, folder), "odd")
            assert docs.columns == columns
        kept = [(r.doc_id, r.file, r.row, r.stays, r.key, r.start) for r in docs.collect()]
        # of the equal texts the longest stays, which has no id; of those like it, the smallest id
        assert sorted(x[0] for x in kept) == ([3, 4, 5] if these else [])
        assert all(x[1:] == ("f", 3, 9, "k", 1) for x in kept)
        got = pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in got} == ({3, 4, 5} if these else set())


def test_join_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(6)
    texts = [" ".join(rng.choices("a b C d é f".split(), k=rng.randint(0, 40))) for _ in range(60)]
    rows = [*enumerate(texts + [t + " x" for t in texts[:20]] + [texts[0].upper(), "\x0b a\tB ", "a b", "A B", ""]), (99, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(queries.ORACLE_SQL["op6_ngram_join"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in queries.op6_ngram_join(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len({c for *_, c in got}) < len(got)


def test_word_hashes_are_told_apart_by_all_their_bytes():
    swapped = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(12):
        word += word.translate(swapped)
        hashes, counts = word_hashes([f"{word}\t{word.translate(swapped)} {word.upper()}", ""])
        assert counts.tolist() == [3, 0] and hashes[0] != hashes[1] and hashes[0] == hashes[2]
    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("abü\x01"), rng.integers(1, 140))) for _ in range(4000)})
    hashes, counts = word_hashes([" ".join(words[:100]), " ".join(words[100:]), "  "])
    assert counts.tolist() == [100, len(words) - 100, 0] and len(np.unique(hashes)) == len(words)
    assert (word_hashes([x + "\n" for x in words])[0] == hashes).all()


def test_columns_of_any_name_are_carried(spark):
    rows = [(1, "a b c d e f"), (2, "a b  c d e f"), (3, None), (4, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as __file", "7 as __row", "1 as file", "2 as row", "named_struct('row_index', 5) as _metadata", "'w' as whole", "0 as size")
    for got, stay in ((dedup.deduplicate(df), {2, 3}), (ngram_join.one_of_each(df), {1, 3})):
        assert got.columns == df.columns
        assert {(x.doc_id, x["__file"], x["file"], x["row"], x["_metadata"].row_index, x["whole"]) for x in got.collect()} == {(i, "x", 1, 2, 5, "w") for i in stay}
