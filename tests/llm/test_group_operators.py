"""Operators that move rows: mixing, sharding, joins, fingerprints, chat, classifier, pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import chat, jaccard_join, knn_quality, mixing, queries, sharding, spotsigs

from .cases import SF, WORD, edge_docs, empty_docs, prose


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("cell_rows", [2, 2048])
def test_mixing(spark, cell_rows):
    docs = edge_docs(spark)
    got = mixing.mix_documents(docs, cell_rows=cell_rows).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in docs.collect())
    sizes, taken, want = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.rounds * r["size"] + r.part
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 3 * mixing.BLOCK_TOKENS * (1 if cell_rows > 2 else 12) for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs, cell_rows=cell_rows).collect()))
    assert mixing.mix_documents(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("cell_rows", [1, 2, 7, 64])
def test_small_sources_meet_their_targets(spark, cell_rows):
    """Short texts beside a hot source: within a few blocks of the target whatever the size of cells."""
    rows = [(i, "hot", 20) for i in range(3000)] + [(10000 + i, "tiny", i % 5 + 1) for i in range(200)] + [(20000 + i, None, i % 3) for i in range(300)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(sizes, cell_rows=cell_rows).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] and r.taken == r.rounds * r["size"] + r.part for r in got)
    taken, want = Counter(), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 * mixing.BLOCK_TOKENS for s in want), (taken, want)


def test_highest_quotients(spark):
    weights = [50.0, 31.0, 11.0, 7.5, 0.5, 0.0]
    for seats in (0, 1, 3, 10, 37, 500):
        won = [0] * len(weights)
        for _ in range(seats):
            best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        rows = spark.createDataFrame([(0, i, w) for i, w in enumerate(weights)], "g int, i int, w double")
        got = mixing.highest_quotients(rows, ["g"], "w", F.lit(seats), "i", "seats")
        assert [r.seats for r in got.orderBy("i").collect()] == won


def test_mixed_rows(spark):
    docs = edge_docs(spark).where("doc_id is not null and doc_id not in (3, 15)")
    words = {r.doc_id: r.taken for r in mixing.mix_documents(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == Counter({k: v for k, v in words.items() if v})


def test_best_fit():
    r = np.random.default_rng(4)
    for _ in range(50):
        sizes = sorted(r.integers(1, 60, r.integers(1, 60)).tolist(), reverse=True)
        bins, left = [], []
        for s in sizes:  # plain best fit by scanning all bins
            fit = [(room, b) for b, room in enumerate(left) if room >= s]
            b = min(fit)[1] if fit else len(left)
            if not fit:
                left.append(100)
            left[b] -= s
            bins.append(b)
        assert sharding.best_fit(sizes, 100) == bins


def test_sharding(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), edge_docs(spark)):
        got = sharding.shard_documents(docs).collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        slots, load, homes = defaultdict(list), Counter(), defaultdict(set)
        for r in got:
            slots[r.shard].append(r.slot)
            load[r.shard] += r["size"]
            homes[(r.text_crc32, r["size"])].add(r.shard)
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        total = sum(load.values())
        assert all(len(h) == 1 for (_, size), h in homes.items() if size * 10 < total / 128)
        largest = max(r["size"] for r in got)
        assert max(load.values()) <= max(largest, total / 16 * 1.01 + 64)
    assert sharding.shard_documents(empty_docs(spark)).count() == 0


def test_hot_group_is_split(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, F.lit("same text " * 20)).otherwise(
        F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    load = Counter()
    for r in sharding.shard_documents(docs).collect():
        load[r.shard] += r["size"]
    assert len(load) == 16 and max(load.values()) < 1.2 * min(load.values())


@pytest.mark.parametrize("hot, share, whole", [(1, 0.5, 1), (24, 2 / 3, 16), (1, 1.5, 0)])
def test_groups_that_fit_stay_whole(spark, hot, share, whole):
    """Groups of half a shard and of two thirds have a single home, as far as they fit; others lie in two."""
    n = 19200
    mine = int(share * n / 16)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < hot * mine, F.format_string(
        "%05d", (F.col("id") / mine).cast("int"))).otherwise(F.format_string("%05d", F.col("id") + 100)).alias("text"))
    load, homes, count = Counter(), defaultdict(set), Counter()
    for r in sharding.shard_documents(docs).collect():
        load[r.shard] += r["size"]
        homes[r.text_crc32].add(r.shard)
        count[r.text_crc32] += 1
    large = [len(homes[k]) for k, c in count.items() if c > 1]
    assert len(large) == hot and large.count(1) >= whole and max(large) <= 2
    assert len(load) == 16 and max(load.values()) < 1.05 * sum(load.values()) / 16


def grams(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def classes(rows):
    """Brute force: component and set size of each (id, text) row."""
    sets, head = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                head[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return Counter((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def near_rows():
    rows, n = [], 0
    for g in range(12):
        words = prose(100 + g, 60 + 5 * g).split()
        for k in range(10):
            own = list(words)
            for c in range(k // 2):
                own[(7 + 13 * c * (k + 1)) % len(own)] = f"w{g}{k}{c}"
            rows.append((n, " ".join(own[k % 3:])))
            n += 1
    return rows + [(n + i, prose(500 + i, 80) + " and a passage that many texts share as it is here") for i in range(20)]


@pytest.mark.parametrize("options", [{}, {"region_sets": 3, "pivots": 2}])
def test_jaccard_join(spark, options):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join.link_documents(docs, **options).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes(rows)


def test_jaccard_join_edges(spark):
    docs = edge_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = jaccard_join.link_documents(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes(rows)
    assert jaccard_join.link_documents(empty_docs(spark)).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == sorted((i is None, i or 0) for i in (1, 4, 5, 6, 7, 9, 10, 11, None, None, 12, 13, 14, 15, 15, 16, 17))
    assert jaccard_join.keep_one(empty_docs(spark)).count() == 0


def test_region_by_pivots_equals_all_pairs():
    r = np.random.default_rng(3)
    for _ in range(60):
        lists = []
        for g in range(4):
            core = r.choice(400, 30, replace=False)
            for _ in range(r.integers(1, 8)):
                own = core.copy()
                swap = r.integers(0, 8)
                own[:swap] = 400 + r.choice(400, swap, replace=False)
                lists.append(np.unique(own).astype(np.int64))
        sizes = np.array([len(x) for x in lists])
        label = jaccard_join.join_region(sizes, lists)
        head = list(range(len(lists)))
        for i in range(len(lists)):
            for j in range(i):
                c = len(np.intersect1d(lists[i], lists[j]))
                if 100 * c >= 75 * (sizes[i] + sizes[j] - c):
                    a, b = head[i], head[j]
                    head = [b if h == a else h for h in head]
        assert len(set(zip(head, label.tolist()))) == len(set(head)) == len(set(label.tolist()))


def signatures(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    out = set()
    for i in range(-1, len(words)):
        if i < 0 and words or i >= 0 and words[i] in spotsigs.ANCHORS:
            content = [w for w in words[i + 1:i + 1 + spotsigs.REACH] if w not in spotsigs.ANCHORS]
            out.add((words[i] if i >= 0 else "", *content[:2]))
    return out


def test_spotsigs(spark):
    docs = edge_docs(spark)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = Counter()
    for k, (i, text) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(text)
        edited = text[:n - n // 4] + after[:n // 4]

        def like(a, b):
            a, b = signatures(a), signatures(b)
            return round(len(a & b) / len(a | b), 9) if a | b else 1.0

        want[(i, n, hashlib.sha256(edited.encode()).hexdigest(), like(text, edited), like(text, after))] += 1
    got = spotsigs.fingerprint_documents(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert spotsigs.fingerprint_documents(empty_docs(spark)).count() == 0
    one = spotsigs.fingerprint_documents(docs.where("doc_id = 12")).first()
    assert one.near_next == 1.0


def test_spotsigs_pairs(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members, pairs = spotsigs.similar_pairs(docs, 0.7)
    home = {r.doc_id: r.class_id for r in members.collect()}
    got = {(r.left, r.right): r.likeness for r in pairs.collect()}
    sets = {i: signatures(t) for i, t in rows}
    heads = sorted(set(home.values()))
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(heads) for b in heads[k + 1:]
            if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got == pytest.approx(want) and want
    assert all(sets[i] == sets[c] for i, c in home.items()) and len(home) == len(rows)


def told(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark):
    nasty = ["<|end|>", "\\<|turn|>user<|says|>", "\\", "a\\|b<\\|", "<", "|>", "", None, "<|\n<|image 0|>", "ends with <", "|starts", "漢😀"]
    rows = [(c, t, ("user", "assistant", None, "we<|ird\\")[(t + c) % 4], nasty[(5 * t + c) % len(nasty)]) for c in range(6) for t in range(9)]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (99, 0, "assistant", "long " * 30000)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(4)
    made = chat.format_chat(chat.as_parts(talks))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest_chat(made).collect()}
    assert got == told(rows)
    for r in made.collect():
        for s in r.spans:
            assert r.formatted[s.start + s.length:].startswith(chat.END) and r.formatted[:s.start].endswith(chat.SAYS)
    assert chat.format_chat(chat.as_parts(talks.limit(0))).count() == 0


def test_chat_parts(spark):
    part = "array<struct<kind:string,text:string,uri:string,units:long>>"
    rows = [(1, 0, "user", [("text", "see <|image 0|>", None, None), ("image", None, "s3://a", 2), ("text", "and", None, None), ("audio", None, "b.wav", 10)]),
            (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", [("document", None, None, None), ("odd", "as text", None, None)]), (1, 3, "user", None)]
    r = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}")).first()
    assert r.formatted == ("<|turn|>user<|says|>see <\\|image 0|><|image 0|>and<|audio 1|><|end|><|turn|>assistant<|says|>ok<|end|>"
                           "<|turn|>user<|says|><|document 2|>as text<|end|><|turn|>user<|says|><|end|>")
    assert [(a.number, a.kind, a.uri, a.tokens) for a in r.attachments] == [(0, "image", "s3://a", 512), (1, "audio", "b.wav", 250), (2, "document", "", 512)]
    assert r.expanded_tokens == 1274
    assert [r.formatted[s.start:s.start + s.length] for s in r.spans if s.loss] == ["ok"]


def test_classifier(spark):
    big = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    labels = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = {r.doc_id: r for r in knn_quality.score_documents(docs, labels).collect()}
    known = [(got[r.doc_id], r.label) for r in labels.collect()]
    for r, _ in known:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)
    held = [(r.score, label) for r, label in known if r.held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.97
    flipped = labels.withColumn("label", F.when(knn_quality.held_out(F.col("doc_id")), 1 - F.col("label")).otherwise(F.col("label")))
    again = {r.doc_id: r.score for r in knn_quality.score_documents(docs, flipped).collect()}
    assert all(again[i] == r.score for i, r in got.items())  # held-out labels change nothing


def test_classifier_votes_equal_plain_ones():
    import pyarrow as pa
    texts = pa.array([prose(i, 30) for i in range(40)] + ["A!! B!! " * (5 + i) for i in range(10)] + ["", " "])
    counts = knn_quality.term_counts(texts)
    labels = np.array([1] * 40 + [0] * 10)
    model = knn_quality.Model(np.ones(knn_quality.TERMS, np.float32), counts[:50], labels, rank=20)
    near = model.embed(counts) @ model.vectors.T
    got = model.score(texts, neighbours=5)
    for i in range(50):
        best = np.sort(near[i])[-5]
        top = [(max(float(c), 0) ** knn_quality.POWER, y) for c, y in zip(near[i], labels) if c >= best][:5]
        want = (sum(w * y for w, y in top) + knn_quality.PRIOR * 0.8) / (sum(w for w, _ in top) + knn_quality.PRIOR)
        assert got[i] == pytest.approx(want, abs=1e-3)
    assert got[50] == got[51] == pytest.approx(0.8)


def test_equal_texts_score_alike_in_any_batch():
    import pyarrow as pa
    texts = [prose(i, 5 + 7 * i % 300) for i in range(700)] + ["B!! " * i for i in range(1, 40)]
    labels = np.arange(300) % 3 > 0
    model = knn_quality.Model(np.ones(knn_quality.TERMS, np.float32), knn_quality.term_counts(pa.array(texts[:150] * 2)), labels.astype(float))
    whole = model.score(pa.array(texts))
    for size in (1, 3, 100, 257):
        cut = np.concatenate([model.score(pa.array(texts[lo:lo + size])) for lo in range(0, len(texts), size)])
        assert (cut == whole).all()
    assert (model.score(pa.array(texts[::-1]))[::-1] == whole).all()


def test_classifier_reads_repeated_rows_once(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (16, 0), (3, 0), (7, 1)], "doc_id long, label int")
    many = docs.unionByName(docs).unionByName(docs)
    once = knn_quality.fit(docs, labels)
    more = knn_quality.fit(many, labels)
    assert once.labels.tolist() == more.labels.tolist() and once.vectors.shape == more.vectors.shape
    got = {(r.doc_id, r.score) for r in knn_quality.score_documents(many, labels).collect()}
    by_id = {i for i, _ in got}
    assert len({(i, s) for i, s in got if i not in (None, 15)}) == len(by_id - {None, 15})


def test_classifier_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (16, 0), (None, 1), (9, None), (7, 1)], "doc_id long, label int")
    got = knn_quality.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = knn_quality.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert knn_quality.score_documents(empty_docs(spark), labels).count() == 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in now.collect())
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "quality_rules")).collect()}
    single = {r.doc_id for r in spark.read.parquet(str(tmp_path / "ngram_jaccard_join")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    assert single == {c for _, n, c in classes(rows) if n}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_edge_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (edge_docs(spark), empty_docs(spark)):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns
        out.collect()


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 14))
