"""Operators that work row by row: personal data, licences, quality rules, tokens."""

import hashlib
import random
import re
import sys
from collections import Counter

import pytest
import sentencepiece

from lodestar.llm import license_scan, pii, quality_rules, tokens

from .cases import SF, WORD, edge_docs, empty_docs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


def test_personal_data_equals_patterns():
    r = random.Random(5)
    for k in range(20000):
        text = "".join(r.choice("0123456789012345678901234567..--+@ab ()%\n" if k % 3 else "0123456789 -.1") for _ in range(r.randint(0, 45)))
        want = base_spans(text)
        got = pii.find_spans(text)
        assert {kind: got.get(kind, []) for kind in pii.BASE_KINDS} == want, text


def test_personal_data_rows(spark):
    docs = edge_docs(spark)
    got = pii.scan_documents(docs).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    want = Counter()
    for (i, text), n in texts.items():
        spans = base_spans(text)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in pii.BASE_KINDS for s, e in spans[k]).encode()).hexdigest()
        want[(i, *(len(spans[k]) for k in pii.BASE_KINDS), digest)] += n
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.scan_documents(empty_docs(spark)).count() == 0


def test_redaction_leaves_clean_texts(spark):
    docs = edge_docs(spark)
    clean = pii.redact_documents(docs)
    assert clean.columns == docs.columns
    before = {(r["doc_id"], r["lang"], r["source"]): r["text"] for r in docs.collect() if r["doc_id"] not in (3, 15, None)}
    for r in clean.collect():
        if r["doc_id"] == 13:
            assert r["text"] == "mail me: [EMAIL] or [PHONE], [CARD], [IP]. MIT License" and r["n_chars"] == len(r["text"])
        elif r["doc_id"] not in (3, 15, None):
            assert r["text"] == before[(r["doc_id"], r["lang"], r["source"])]
    assert pii.redact('token = "0123456789abcdef" at https://a.b/c.', pii.find_spans('token = "0123456789abcdef" at https://a.b/c.')) == 'token = "[SECRET]" at [URL].'


def test_numbers_behind_failed_matches():
    text = "+1 (706) 555-3138 4644348398010899 x 12 4111 1111 1111 1111 7"
    spans = pii.find_spans(text)
    assert "phone" not in spans and [text[s:e] for s, e in spans["phone_part"]] == ["+1 (706) 555-3138"]
    assert [text[s:e] for s, e in spans["card_part"]] == ["4644348398010899", "4111 1111 1111 1111"]
    assert pii.redact(text, spans) == "[PHONE_PART] [CARD_PART] x 12 [CARD_PART] 7"


def test_account_numbers_as_written():
    def accounts(text):
        return [text[s:e] for s, e in pii.find_spans(text).get("account", [])]

    iban = "DE89 3704 0044 0532 0130 00"
    for written in (iban, iban.replace(" ", ""), iban.replace(" ", "-"), "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947"):
        for before in ("IBAN ", "IBAN: ", "pay to ", "", "Account No. ", "("):
            for after in ("", " please", ".", ", BIC X", ")"):
                assert accounts(before + written + after) == [written], before + written + after
    for cue in ("account number ", "Account No. ", "Acct Nr. ", "account no: ", "ACCOUNT NUMBER: ", "account number is ", "Account #"):
        for number in ("12345678", "1234 5678 9012", "12-34-56 12345678", "1234-5678-9012", "AB12345678"):
            assert accounts(cue + number + " AND more") == [number], cue + number
    assert accounts("account 12345678 2024 IBAN " + iban) == ["12345678", iban]
    assert accounts("DE89 3704 0044 0532 0130 01 XDE89370400440532013000 account number none, accounts 2024") == []
    assert pii.redact("to " + iban + ".", pii.find_spans("to " + iban + ".")) == "to [ACCOUNT]."


def test_licences_equal_scan(spark):
    docs = edge_docs(spark)
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    want = Counter()
    for r in docs.collect():
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        places, labels = [], set()
        for phrase, label in license_scan.BASE:
            parts = phrase.split()
            here = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
            places += here
            labels |= {label} if here else set()
        want[(r["doc_id"], len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))] += 1
    got = license_scan.scan_documents(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    assert license_scan.scan_documents(empty_docs(spark)).count() == 0


def plain_scan(words, idf):
    """Labels and score of a word list: every phrase at every place."""
    labels, score = set(), 0.0
    for label, key, full in license_scan.TEMPLATES:
        key, full = key.encode().split(), full.encode().split()
        at = next(i for i in range(len(full)) if full[i:i + len(key)] == key)
        for i in range(len(words) - len(key) + 1):
            if words[i:i + len(key)] == key:
                labels.add(label)
                got = sum(idf[w] for j, w in enumerate(full) if 0 <= i - at + j < len(words) and words[i - at + j] == w)
                score = max(score, got / sum(idf[w] for w in full))
    return labels, min(1.0, score)


def test_license_labels_and_score_equal_a_plain_scan(spark):
    docs = edge_docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    idf = license_scan.word_idf(docs)
    want = Counter()
    for r in docs.collect():
        labels, score = plain_scan(license_scan.words_of_text(r["text"] or ""), idf)
        want[(r["doc_id"], ",".join(sorted(labels)), round(score, 9))] += 1
    got = license_scan.scan_documents(docs).collect()
    assert Counter((r.doc_id, r.labels, round(r.score, 9)) for r in got) == want
    assert any(r.labels for r in got)


def test_license_places_are_few_and_complete():
    r = random.Random(3)
    words = sorted({w for _, key, full in license_scan.TEMPLATES for w in (key + " " + full).encode().split()})
    phrases = [key.encode().split() for _, key, _ in license_scan.TEMPLATES]
    for lookups in (1, 2, 3, 9):
        index = license_scan.RareTokenIndex({w: 1.0 + (len(w) % 4) for w in words}, lookups)
        for _ in range(400):
            text = [w for _ in range(r.randint(0, 12)) for w in (r.choice(phrases) if r.random() < 0.3 else [r.choice(words)])]
            labels, score = plain_scan(text, index.idf)
            places, base, got, got_score = index.scan(text)
            assert got == labels and abs(score - got_score) < 1e-12
            want = [i for phrase, _ in license_scan.BASE for i in range(len(text)) if text[i:i + len(phrase.split())] == phrase.encode().split()]
            assert sorted(places) == sorted(want)
    index = license_scan.RareTokenIndex({w: 1.0 for w in words})
    scattered = b"public license general public public license general license".split()
    assert all(not starts for starts in index.places(scattered).values())     # no place survives the intersection


def rule_base(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    twice = {p for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for p in range(i, i + 5)}
    n, again = len(words), len(twice)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), again, n < 10 or 100 * again > 20 * n)


def test_quality_rules_base(spark):
    docs = edge_docs(spark)
    got = quality_rules.judge(docs).collect()
    want = Counter((r["doc_id"], *rule_base(r["text"] or "")) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.judge(empty_docs(spark)).count() == 0


def test_quality_rules_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality_rules.judge(docs).collect()
    known = [(r.kept, labels[r.doc_id]) for r in got if not r.base_failed and r.doc_id in labels]
    assert all(kept for kept, good in known if good)
    assert sum(not kept for kept, good in known if not good) >= 0.9 * sum(not good for _, good in known)
    stays = quality_rules.keep_good(docs)
    assert stays.columns == docs.columns
    assert sorted(r.doc_id for r in stays.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_quality_rules_keep_other_languages(spark):
    """Clean documents of languages without a word list stay; junk of a listed language still goes."""
    r = random.Random(4)
    alphabets = {"ru": "абвгдежзиклмнопрст", "el": "αβγδεζηθικλμνοπρστ", "hi": "कखगघचजटडतदनपबमयरलवसह", "fi": "aehijklmnoprstuvyäö"}

    def text(lang):
        return "\n".join(" ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randint(4, 9))) for _ in range(12)) + "." for _ in range(8))

    other = [(10 ** 6 + i, text(lang), known) for i, (lang, known) in enumerate(
        [(lang, known) for lang in alphabets for known in (lang, None, "en" if lang != "fi" else "fi-FI")] * 3)]
    junk = [(2 * 10 ** 6 + i, " | ".join(text("fi").split()), "en") for i in range(3)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame(other + junk, "doc_id long, text string, lang string"))
    kept = {x.doc_id: x.kept for x in quality_rules.judge(docs).collect()}
    assert all(kept[i] for i, _, _ in other) and not any(kept[i] for i, _, _ in junk)
    stays = {x.doc_id for x in quality_rules.keep_good(docs).collect()}
    assert stays == {i for i, good in kept.items() if good}


def test_estimate_equals_plain_em(spark):
    """EM on the pattern table is EM on the documents one by one."""
    import math
    rows = [(-1, 0)] * 7 + [(0, 1)] * 40 + [(0, 0)] * 5 + [(-1, 1)] * 2 + [(0, -1)] * 3
    got = quality_rules.estimate(spark.createDataFrame(rows, "v_a int, v_b int"), ["a", "b"], rounds=4)
    w, start = quality_rules._WEIGHT, quality_rules._START
    good, low, high = start["good"], [start["low"]] * 2, [start["high"]] * 2
    for _ in range(4):
        g = []
        for votes in rows:
            odds = math.log(good / (1 - good))
            for j, v in enumerate(votes):
                odds += math.log(low[j][1] / low[j][0]) if v < 0 else math.log(high[j][1] / high[j][0]) if v > 0 else 0
            g.append(1 / (1 + math.exp(-odds)))
        n, sg = len(rows), sum(g)
        good = min(0.98, max(0.5, (sg + w * start["good"]) / (n + w)))
        for j in range(2):
            for share, name, sign, up in ((low, "low", -1, False), (high, "high", 1, True)):
                b = (sum(1 - p for p, v in zip(g, rows) if v[j] == sign) + w * start[name][0]) / (n - sg + w)
                a = (sum(p for p, v in zip(g, rows) if v[j] == sign) + w * start[name][1]) / (sg + w)
                share[j] = (min(a, b), max(a, b)) if up else (max(a, b), min(a, b))
    assert got["good"] == pytest.approx(good)
    assert got["a"][0] == pytest.approx(low[0]) and got["b"][1] == pytest.approx(high[1])


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL)


def test_tokens_equal_library(library):
    encoder = tokens.Encoder(tokens.Vocabulary())
    r = random.Random(9)
    texts = ["".join(r.choice("etaoinshrdlu  qz\n\tÉé漢😀▁.,019") for _ in range(r.randint(0, 90))) for _ in range(4000)]
    ids = encoder.encode(texts)
    assert ids == library.encode(texts)
    assert [tokens.decode(i, encoder.v.raw) for i in ids] == library.decode(ids)
    assert tokens.decode([library.piece_to_id("<0xFF>")], encoder.v.raw) == "�"


def test_unigram_walk_finds_best_paths(tmp_path, library):
    """A unigram model of the same pieces: path scores equal the library's Viterbi."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import math
    model = pb.ModelProto()
    with open(tokens.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = -8 - math.log1p(-p.score)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    encoder, sp = tokens.Encoder(tokens.Vocabulary(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    assert not encoder.v.bpe
    r = random.Random(2)
    for _ in range(500):
        text = "".join(r.choice("the and of information system ") for _ in range(r.randint(1, 60)))
        mine, theirs = encoder.encode([text])[0], sp.encode(text)
        assert tokens.decode(mine, encoder.v.raw) == text
        assert sum(map(sp.get_score, mine)) == pytest.approx(sum(map(sp.get_score, theirs)), abs=1e-2)


def test_tokens_of_long_shared_heads_and_bounded_memories(library, monkeypatch):
    """Words alike for longer than is compared at once, characters that look like its padding, no room to remember anything."""
    r = random.Random(4)
    head = "".join(r.choice("etaoin") for _ in range(300))
    texts = [head[:r.randint(0, 300)] + r.choice("abcé漢") for _ in range(200)] + [head[:k] for k in range(20, 30)] + ["  a", "a  ", "a", " "]
    want = library.encode(texts)
    assert tokens.Encoder(tokens.Vocabulary()).encode(texts) == want
    for name in ("_CACHE", "_PAIRS", "_STEPS"):
        monkeypatch.setattr(tokens, name, 0)
    encoder = tokens.Encoder(tokens.Vocabulary())
    assert [encoder.encode([t])[0] for t in texts] == want
    odd = ["a", "a\0", "a\0\0", "b\0 a", "\0"]
    assert [tokens.decode(i, encoder.v.raw) for i in encoder.encode(odd)] == odd


def test_words_met_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "_CACHE", 50)
    encoder = tokens.Encoder(tokens.Vocabulary())
    walked, walk = [], encoder._walk_bpe
    monkeypatch.setattr(encoder, "_walk_bpe", lambda words: (walked.extend(words), walk(words)))
    often, other = (" ".join(f"{c}{k}" for k in range(100)) for c in "ab")
    want = encoder.encode([often])
    encoder.encode([other])
    assert encoder.encode([often]) == want
    assert len(walked) == len(set(walked)) == 200


def test_work_for_each_character_of_new_words():
    """Lines of the module that run while new words are encoded, their pairs of pieces being known."""
    encoder = tokens.Encoder(tokens.Vocabulary())
    r = random.Random(8)
    parts = "the of and er tion ing st an en ou nd th ea on sh re in ti ha ble".split()
    text = " ".join({"".join(r.choices(parts, k=r.randint(2, 5))) for _ in range(3000)})
    want = encoder.encode([text])
    encoder.forget()
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        if frame.f_code.co_filename != tokens.__file__:
            return None
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        got = encoder.encode([text])
    finally:
        sys.settrace(before)
    assert got == want
    assert lines < 10 * len(text), lines / len(text)


def test_token_rows(spark, library):
    docs = edge_docs(spark)
    got = tokens.encode_documents(docs)
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    assert all(r.round_trip for r in got.collect() if r.doc_id != 15)
    back = {r.doc_id: r.text for r in tokens.decode_documents(got).collect()}
    assert back[11] == "Straße été 漢字 😀 naïve" and back[4] == "" and back[10] == "x" * 50000
    assert tokens.encode_documents(empty_docs(spark)).count() == 0
