"""SimHash, periodic runs and conversation repair against brute-force versions."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from lodestar.llm import conversation_repair, periodic_runs, queries, simhash

from .cases import CLASHES, SF, WORD, edge_docs, edge_rows, empty_docs

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(prints, radius=4):
    """Least index that each print reaches by links."""
    bits = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def check_simhash(rows, got):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [plain_print(t) for _, t in rows]
    label = reached(prints)
    want = sorted(((d, f"{p:016x}", rows[k][0]) for (d, _), p, k in zip(rows, prints, label)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_simhash_edges(spark):
    check_simhash([(r[0], r[1]) for r in edge_rows()], simhash.link_documents(edge_docs(spark)).collect())
    assert simhash.link_documents(empty_docs(spark)).count() == 0


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_simhash([tuple(r) for r in docs], queries.QUERIES["op11_simhash"](spark, SF).collect())


@pytest.mark.parametrize("bucket", [1, 4, 2048])
def test_links_whatever_the_bucket(spark, bucket):
    """Dense clusters: buckets above the bound go through parts and the second level of masks."""
    r = random.Random(bucket)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(30):
            y = x
            for b in r.sample(range(64), r.randint(0, 6)):
                y ^= 1 << b
            prints.add(y)
    prints = sorted(prints)
    label = reached(prints)
    groups = {}
    for p, k in zip(prints, label):
        groups.setdefault(k, set()).add(p)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    told = {}
    for row in simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"), bucket=bucket).collect():
        told.setdefault(row.label, set()).add(row.node % (1 << 64))
    assert sorted(map(sorted, told.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_masks_cover_every_four_bits():
    masks = simhash.covering_masks((1 << 64) - 1)
    assert len(masks) == 31 and all(32 <= m.bit_count() <= 34 for m in masks)
    r = random.Random(3)
    for _ in range(3000):
        diff = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not diff & m for m in masks)
    free = ~masks[0] & ((1 << 64) - 1)
    finer = simhash.covering_masks(free)
    bits = [b for b in range(64) if free >> b & 1]
    for _ in range(1000):
        diff = sum(1 << b for b in r.sample(bits, 4))
        assert any(not diff & m for m in finer)


def plain_runs(words):
    spans = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            s = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i - s >= q:
                spans.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in spans.items() if e - s >= max(6, 4 * q))


def test_runs_of_random_words():
    r = random.Random(12)
    for _ in range(1500):
        docs = []
        for _ in range(r.randint(1, 4)):
            words = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randint(0, 70))]
            if words and r.random() < 0.6:
                a, p = r.randrange(len(words)), r.randint(1, 9)
                words = words[:a] + [words[min(len(words) - 1, a + (i - a) % p)] for i in range(a, len(words))]
            docs.append(words)
        lengths = np.array([len(d) for d in docs])
        want = [(s + b, n, q) for d, b in zip(docs, np.cumsum(lengths) - lengths) for s, n, q in plain_runs(d)]
        assert periodic_runs.find_runs(np.array([w for d in docs for w in d], np.int64), lengths) == want


@pytest.mark.parametrize("chunk", [1, 1 << 20])
def test_long_runs(monkeypatch, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    for words in ([0] * 3000, [0, 1] * 1500, [0, 1, 1] * 500 + [0, 1] * 400, [0, 0, 1, 0, 0, 1, 1] * 300):
        assert periodic_runs.find_runs(np.array(words), np.array([len(words)])) == plain_runs(words)


def plain_digest(doc_id, text, planted):
    words = WORD.findall(text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if planted and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def digest_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
                   for r in df.collect()), key=str)


def test_runs_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 20000]
    got = digest_rows(queries.QUERIES["op12_periodic_runs"](spark, SF))
    assert len(got) == len(docs)
    keep = {r.doc_id for r in short}
    assert [r for r in got if r[0] in keep] == sorted((plain_digest(r.doc_id, r.text, True) for r in short), key=str)
    assert sum(1 for r in got if r[1]) > 5


def test_runs_edges(spark):
    more = [(100, "a b " * 40 + "c", *[None] * (len(CLASHES) + 3)), (101, "x x x x x", *[None] * (len(CLASHES) + 3)),
            (102, " y\ty\ny y\x0by y ", *[None] * (len(CLASHES) + 3))]
    docs = edge_docs(spark)
    docs = docs.unionAll(spark.createDataFrame(more, docs.schema))
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] != 9] + [m[:2] for m in more]
    got = digest_rows(periodic_runs.digest_runs(periodic_runs.collapse_runs(docs.where("doc_id is null or doc_id <> 9"))))
    assert got == sorted((plain_digest(d, t, False) for d, t in rows), key=str)
    assert len(digest_rows(periodic_runs.digest_runs(periodic_runs.collapse_runs(docs)))) == docs.count()
    planted = digest_rows(periodic_runs.digest_runs(periodic_runs.collapse_runs(periodic_runs.with_planted_runs(docs.where("doc_id is null or doc_id <> 9")))))
    assert planted == sorted((plain_digest(d, t, True) for d, t in rows), key=str)
    assert periodic_runs.digest_runs(periodic_runs.collapse_runs(periodic_runs.with_planted_runs(empty_docs(spark)))).count() == 0


def plain_repair(rows):
    """``rows(role, text, fault)``: every cheapest audit as a whole string, by state of the output."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit, out) in list(best.items()):
                for c, new in step[state].items():
                    if c != "s":
                        cand = (cost + 5, audit + "I", out + [f"{name[c]}:"])
                        if new not in best or cand[:2] < best[new][:2]:
                            best[new] = cand
        return best

    best = {"": (0, "", [])}
    for role, text, fault in rows:
        new = {}

        def offer(state, cand):
            if state not in new or cand[:2] < new[state][:2]:
                new[state] = cand
        for state, (cost, audit, out) in inserted(best).items():
            offer(state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            for c, to in step[state].items():
                if role[:1] == c:
                    offer(to, (cost + more, audit + "K", out + [f"{role}:{text}"]))
                if c != "s":
                    offer(to, (cost + more + 1, audit + "R", out + [f"{name[c]}:{text}"]))
        best = new
    best = inserted(best)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_conversations(rows, damage=True):
    told = {}
    for conv, turn, role, text in rows:
        told.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        told[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, turns in told.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, sha = plain_repair([(r, t, f) for (_, r, t), f in zip(turns, faults)])
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, sha))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_repair_query(spark):
    talks = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repair_rows(queries.QUERIES["op13_conversation_repair"](spark, SF)) == plain_conversations(talks)


TALK = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                     T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("key", "seq", "first", "state", "kind")])


def random_talks(seed, n_conv, longest):
    r = random.Random(seed)
    rows = []
    for conv in [None, -7, *range(n_conv)]:
        turn = r.randint(-2, 2)
        for _ in range(r.randint(1, longest)):
            turn += r.choice([0, 1, 1, 1, 2])
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "umpire"])
            text = r.choice([f"said {r.randint(0, 9)}.", "Yes.", "No!", "cut", "", " \t", None, "why? ", "und so weiter", "漢字。"])
            rows.append((conv, r.choice([turn] * 9 + [None]), role, text))
    return rows


def test_repair_of_random_conversations(spark):
    rows = random_talks(4, 400, 14)
    df = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], TALK).repartition(5)
    assert repair_rows(conversation_repair.repair_conversations(df)) == plain_conversations(rows, damage=False)
    assert repair_rows(conversation_repair.repair_conversations(conversation_repair.with_damage(df))) == plain_conversations(rows)
    empty = spark.createDataFrame([], TALK)
    assert conversation_repair.repair_conversations(conversation_repair.with_damage(empty)).count() == 0


@pytest.mark.parametrize("limit", [1, 256])
def test_repair_of_a_long_conversation(limit):
    """Prefixes are settled on the way: nodes and held texts stay few, the audit is that of the plain version."""
    rows = [(role or " ", text or " ") for _, _, role, text in random_talks(9, 40, 60)]
    said, most = [], 0
    repair = conversation_repair.Repair(lambda *edit: said.append(edit), limit)
    faults = []
    for k, (role, text) in enumerate(rows):
        repair.add(k, role, text, k % 11 == 5)
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append((role, text, "blank" if not end else "duplicate" if k % 11 == 5 else "" if end in ".!?" else "truncated"))
        most = max(most, len(repair.pending), len(repair.audits.letter))
    told = repair.finish()
    assert (told["cost"], told["audit"], told["repaired_sha256"]) == plain_repair(faults)
    assert most < 600 < len(rows) and told["audit"] == "".join(e for e, _, _ in said)


def test_repaired_turns(spark):
    rows = random_talks(6, 50, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = {}
    for r in conversation_repair.repaired_turns(df).orderBy("conv_id", "seq").collect():
        told.setdefault(r.conv_id, []).append(r)
    want = {r[0]: r for r in plain_conversations(rows, damage=False)}
    assert set(told) == set(want)
    for conv, edits in told.items():
        assert "".join(e.edit for e in edits) == want[conv][7]
        text = "\n".join(f"{e.role}:{e.text}" for e in edits if e.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == want[conv][8]


def test_colliding_hashes_are_verified():
    """With a tiny modulus nearly all hashes collide; the order must not change."""
    r = random.Random(8)
    for modulus in (1, 2, 3, 7, (1 << 61) - 1):
        audits = conversation_repair.Audits(modulus)
        nodes = [0]
        for _ in range(150):
            nodes.append(audits.add(r.choice(nodes[-12:]), r.choice("DIKR")))
        for _ in range(800):
            a, b = r.choice(nodes), r.choice(nodes)
            assert audits.less(a, b) == (audits.text(a) < audits.text(b))
