"""Line dedup, sharding, license scans, personal data, packing and pieces against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import license_scan, line_dedup, packing, pii, piece_viterbi, sharding, word_bpe

from .conftest import AWKWARD

WORD = re.compile(r"[^\x20\x09-\x0D]")


def dedup_by_hand(rows):
    texts = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, cut = set(), {}
    for d, t in texts:
        lines = [(i, x) for i, x in enumerate(t.split("\n")) if WORD.search(x)]
        for k in range(len(lines) - 2):
            window = tuple(x for _, x in lines[k:k + 3])
            if window in seen:
                cut.setdefault((d, t), set()).update(i for i, _ in lines[k:k + 3])
            seen.add(window)
    return {(d, t): "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut.get((d, t), ())) for d, t in texts}


def test_line_dedup_against_brute_force(docs_of, prose):
    shared = prose(1, 60)
    rows = [(i, prose(i + 10) + "\n" + shared + "\n\n" + prose(i + 50, 24)) for i in range(20)] + [(30, prose(10)), (31, "a\nb\nc\na\nb\nc\nd"), (32, "q\nq\nq\nq\nq")]
    got = {(r.doc_id): r.text for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
    assert got == {d: t for (d, _), t in dedup_by_hand(rows).items()}
    assert got[31] == "a\nb\nc\nd" and got[32] == "q"


def test_line_dedup_awkward(awkward):
    extra = awkward.withColumn("removed", F.lit("clash")).withColumn("hash", F.lit(1)).withColumn("key", F.lit(2))
    out = line_dedup.dedup_lines(extra)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "hash", "key", "n_lines", "n_removed", "removed"]
    rows = out.collect()
    assert len(rows) == len(AWKWARD)
    want = dedup_by_hand(AWKWARD)
    texts = Counter((r.doc_id, r.text) for r in rows)
    assert texts == Counter((d, want[d, t] if t is not None else None) for d, t in AWKWARD)
    assert line_dedup.dedup_lines(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 203])
def test_sharding_law(docs_of, n):
    rows = [(i, "t" * (i % 5)) for i in range(n)]
    df = docs_of(rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    got = sharding.assign_shards(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    sizes = Counter(r.shard for r in got)
    assert not n or max(sizes.get(s, 0) for s in range(8)) - min(sizes.get(s, 0) for s in range(8)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for source in {r.source for r in got}:  # the mixture holds in every shard
        per = Counter(r.shard for r in got if r.source == source)
        assert max(per.get(s, 0) for s in range(8)) - min(per.get(s, 0) for s in range(8)) <= 2
        ranks = np.array(sorted(r.frac for r in got if r.source == source))
        assert 0 < ranks[0] < 1 / len(ranks) + 1e-9 and np.allclose(np.diff(ranks), 1 / len(ranks))
    order = [r.frac for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order)
    assert all(r.text_crc32 == zlib.crc32(("t" * (r.doc_id % 5)).encode()) and r["size"] == r.doc_id % 5 + 1 for r in got)


def test_sharding_of_very_many_small_sources(docs_of):
    docs = docs_of([(i, "t") for i in range(4_000)]).withColumn("source", F.when(F.col("doc_id") < 3_000, F.concat(F.lit("host"), F.col("doc_id"))).otherwise("hot"))
    got = sharding.assign_shards(docs).collect()
    assert len({r.frac for r in got if r.source != "hot"}) > 2_900  # no value, so no bucket, holds them together
    for source_is in (lambda s: s == "hot", lambda s: s != "hot"):
        per = Counter(r.shard for r in got if source_is(r.source))
        assert max(per.values()) < 1.25 * min(per.values())


def test_sharding_awkward(awkward):
    got = sharding.assign_shards(awkward).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, len((t or "").encode()) + 1) for d, t in AWKWARD)
    assert sorted(r.position for r in got) == list(range(len(AWKWARD)))


def license_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts = sorted(i for p in license_scan.PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
    labels = {l for p, l in license_scan.PHRASES.items() if any(words[i:i + len(p.split())] == p.split() for i in range(len(words)))}
    every = set(labels)
    for line in (text or "").split("\n"):
        block = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
        every |= {l for l, t in license_scan.TEMPLATES if len(block & set(t.split())) >= license_scan.THRESHOLD * len(set(t.split())) - 1e-9}
    return len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(labels)), ",".join(sorted(every))


def test_license_scan_against_brute_force(docs_of, prose):
    notices = [t for _, t in license_scan.TEMPLATES]
    rows = [(i, prose(i, 40) + "\n" + notices[i % len(notices)].upper() + (" and more words" if i % 2 else ".") + "\n" + prose(i, 30)) for i in range(40)]
    rows += [(50, " ".join(notices[4].split()[:-1])), (51, "Apache-License, MIT\nLicense cc/by CC BY cc by"), (52, "rights all reserved the"), (53, "redistribution use in source binary forms"), *((100 + i, t) for i, (_, t) in enumerate(AWKWARD))]
    got = {r.doc_id: r for r in license_scan.digest(license_scan.scan_licenses(docs_of(rows))).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == license_by_hand(t), (d, t)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert license_scan.scan_licenses(docs_of([])).count() == 0


def test_license_notices_over_several_lines(docs_of, prose):
    import textwrap

    long = [(l, t) for l, t in license_scan.TEMPLATES if len(t.split()) > 10]
    rows = [(k, prose(k, 30) + "\n\n" + "\n".join(" * " + x for x in textwrap.wrap(t, 50)) + "\n\n" + prose(k, 20)) for k, (_, t) in enumerate(long)]
    rows += [(20, "all rights\n\nreserved"), (21, "all rights"), (22, "reserved"), (23, "all rights\nreserved"), (24, "all " + prose(3, 12) + " rights\nreserved")]
    got = {r.doc_id: r for r in license_scan.digest(license_scan.scan_licenses(docs_of(rows).coalesce(1))).collect()}
    for k, (label, _) in enumerate(long):
        assert label in got[k].labels.split(",") and got[k].score == 1, label
    assert [got[k].labels for k in range(20, 25)] == ["", "", "", "all-rights-reserved", ""]


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def pii_by_hand(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_spans_against_brute_force(docs_of):
    rng = np.random.default_rng(4)
    pieces = ["a@b.c", "a@b.c_x@d.e", "@", "user.name+tag@mail-1.example.org.", "1.2.3.4", "1.2.3.256", "001.02.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111-1",
              "4444 3333 2222 1111 000", "+1 (988) 555-2485", "+1--", "++49 30 1234567", "𝄞", "é", " ", "\n", "-", ".", "12", "word", "+1234567890123456789"]
    texts = ["".join(pieces[k] + (" " if rng.random() < .4 else "") for k in rng.integers(0, len(pieces), rng.integers(1, 14))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    got = {r.doc_id: r for r in pii.digest(pii.find(docs_of(rows))).collect()}
    for d, t in rows:
        spans = pii_by_hand(t)
        assert got[d].spans.split(",term")[0] == ",".join(spans), repr(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]
    assert pii.find(docs_of([])).count() == 0


def test_pii_terms_that_disclose(docs_of, prose):
    rows = [(i, f"{prose(i)}\nReach Confidant{'x' if i % 9 == 8 else ''} desk {prose(i + 500, 6)} at user{i}@mail.example.com today\nplain the line") for i in range(30)]
    rows += [(100 + i, prose(i + 900) + "\nthe desk at home today") for i in range(300)]
    docs = docs_of(rows)
    terms = {r.term: r for r in pii.disclosing_terms(docs).collect()}
    assert {"confidant", "reach"} <= set(terms) and "the" not in terms and "at" not in terms
    assert terms["confidant"].share == 1 and terms["confidant"].removed
    lines = [line for _, t in rows for line in t.split("\n") if re.search("[a-z]", line)]
    both, alone = sum("user" in x and " desk " in f" {x.lower()} " for x in lines), sum(" desk " in f" {x.lower()} " for x in lines)
    assert ("desk" in terms) == (both / alone >= (30 / len(lines)) ** (1 - 1 / pii.ALPHA))
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Confidant " not in out[0] and "[EMAIL]" in out[0] and "@" not in out[0]
    assert out[100] == rows[30][1]
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find(docs)).collect()}
    at = rows[0][1].index("Confidant")
    assert f"term:{at}:{at + 9}" in spans[0].split(",")


def test_pii_names_beside_one_address(docs_of, prose):
    """A name that stands beside its owner's one address or number is a span, wherever it is in that owner's documents."""
    rows = [(i, f"{prose(i)}\nwrite the Quibbleson {prose(i + 500, 6)} or quill@one.example.org today\nthe rest\nask Quibbleson{'.' * i}") for i in range(4)]
    rows += [(10 + i, f"{prose(i + 40)}\ncall the Zorblatt {prose(i + 600, 6)} at +49 30 1234567") for i in range(4)]
    rows += [(20, prose(70) + "\nOnce Hapaxius met once@two.example.org"), (21, "Quibbleson is a name here")]
    rows += [(100 + i, prose(i + 900) + "\nthe desk at home today") for i in range(300)]
    docs = docs_of(rows)
    terms = {(r.term, r.kind): r for r in pii.disclosing_terms(docs).collect() if r.value is not None}
    assert terms["zorblatt", "phone"].share == 1 and terms["zorblatt", "phone"].removed
    assert terms["quibbleson", "email"].share == 4 / 9 and not terms["quibbleson", "email"].removed
    assert not {"the", "hapaxius"} & {t for t, _ in terms}
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Quibbleson" not in out[i] and out[i].endswith("ask [TERM]" + "." * i) and "the rest" in out[i] for i in range(4))
    assert all("Zorblatt" not in out[10 + i] and "[PHONE]" in out[10 + i] for i in range(4))
    assert "Hapaxius" in out[20] and out[21] == rows[9][1] and out[100] == rows[10][1]


def test_pii_sanitise_awkward(awkward):
    out = pii.sanitise(awkward.withColumn("spans", F.lit("clash")))
    assert out.columns == awkward.columns + ["spans"]
    texts = Counter((r.doc_id, r.text) for r in out.collect())
    assert texts[(1, None)] == 1 and texts[(5, "one two")] == 2 and sum(texts.values()) == len(AWKWARD)


def test_word_ids_are_the_library_s(prose):
    bpe = word_bpe.tokenizer(packing.default_tokenizer())
    texts = [prose(1), "It's DON'T we'll 12ab ÉÀ—x…", "İstanbul Σας ﬁ é <|endoftext|> x", "", " ", "a" * 3000, "\x1c a\xa0b", "ß²ª™ ½", "日本 𝄞", *[t or "" for _, t in AWKWARD]]
    for text, ids in zip(texts, bpe.encode(texts)):
        assert ids.tolist() == bpe.library.encode(text, add_special_tokens=False).ids


def test_every_plain_character_is_split_as_the_library_does():
    import random

    bpe = word_bpe.tokenizer(packing.default_tokenizer())
    plain = [chr(c) for c in [9, 10, 13, *range(0x20, 0x180), *range(0x2010, 0x2028)] if not word_bpe.PLAIN.search(chr(c))]
    rng = random.Random(1)
    texts = ["".join(rng.choice(plain) for _ in range(40)) for _ in range(300)] + [f"a{c}b {c} 1{c}{c}" for c in plain]
    for text, ids in zip(texts, bpe.encode(texts)):
        assert ids.tolist() == bpe.library.encode(text, add_special_tokens=False).ids, text


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    key = packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_packing_holds_every_id_once(docs_of, prose):
    rows = [(i, prose(i, 30 + 17 * i)) for i in range(40)] + [(100 + i, prose(3, 200)) for i in range(20)] + [(200 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    got = packing.pack(docs_of(rows)).collect()
    library = word_bpe.tokenizer(packing.default_tokenizer()).library
    for d, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            assert np.array_equal(np.frombuffer(r.ids, np.uint16), ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    line = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert [2048 * r.sequence_id + r.offset for r in line] == np.concatenate(([0], np.cumsum([r.length for r in line])[:-1])).tolist()
    places = [r.place for r in line]
    assert places == sorted(places)  # neighbours on the curve are neighbours in the sequences
    assert packing.pack(docs_of([])).count() == 0


def viterbi_by_hand(model, text):
    """Best score over the whole marked text, without cuts or shared prefixes."""
    s = "▁" + text.replace(" ", "▁")
    best = [0.0] + [None] * len(s)
    for end in range(1, len(s) + 1):
        options = [best[b] + model.score[s[b:end]] for b in range(max(0, end - 16), end) if s[b:end] in model.score]
        best[end] = max(options) if options else best[end - 1] + model.unknown
    return best[-1]


def test_pieces_are_the_best_and_decode(docs_of, prose):
    model = piece_viterbi.pieces(piece_viterbi.default_model())
    texts = [prose(i, 25) for i in range(30)] + ["  two  spaces ", "日本 x𝄞y\n\tz", "a" * 100, "Hello, World! 3.14", ""]
    for text, ids in zip(texts, model.encode([piece_viterbi.marked_words(t) for t in texts])):
        assert model.decode(ids) == text
        if text:
            pieces = sum(model.score.get(next((p for p, n in model.number.items() if n == i), ""), 0) for i in ids if i not in model.byte)
            unknown = sum(1 for c in "▁" + text.replace(" ", "▁") if c not in model.score)
            assert pieces + unknown * model.unknown == pytest.approx(viterbi_by_hand(model, text))


def test_pieces_match_the_library_s_unigram_search(prose):
    """The same pieces and scores as a unigram model of the sentencepiece library give segmentations of the same score."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(open(piece_viterbi.default_model(), "rb").read())
    spec.trainer_spec.model_type = 1
    for p in spec.pieces:
        p.score = max(p.score, -40_000)
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    model = piece_viterbi.pieces(piece_viterbi.default_model())
    texts = [prose(i, 20).replace("\n", " ") for i in range(60)]
    for text, ids in zip(texts, model.encode([piece_viterbi.marked_words(t) for t in texts])):
        assert model.points[ids].sum() == model.points[library.encode(text)].sum()


def test_pieces_awkward(awkward):
    encoded = piece_viterbi.encode_documents(awkward)
    assert encoded.where("not round_trip").count() == 0
    texts = Counter((r.doc_id, r.text) for r in piece_viterbi.decode_documents(encoded).collect())
    assert texts == Counter((d, t or "") for d, t in AWKWARD)
    assert piece_viterbi.encode_documents(awkward.limit(0)).count() == 0


def test_pieces_with_a_score_of_zero_and_long_words():
    import copy

    model = copy.copy(piece_viterbi.pieces(piece_viterbi.default_model()))
    piece = max((p for p in model.score if len(p) > 3), key=len)
    model.endings, model.known = dict(model.endings), {}
    model.endings[piece] = 0.0  # the best score of all: the piece must be taken whole
    ids = np.frombuffer(model.encode_words([piece])[piece], np.int32)
    assert [model.number[piece]] == ids.tolist()
    long = "ab" * 500
    assert len(model.encode([[long], [long]])[0]) and long not in model.known


def test_pii_of_very_long_lists_takes_linear_time(docs_of):
    import time

    def text(n):
        return "\n".join(f"é{i} someone{i}@example.org, 10.0.{i % 250}.{i % 99} ok" for i in range(n))

    def seconds(texts):
        docs = docs_of([(k, t) for k, t in enumerate(texts)]).coalesce(1)
        started = time.time()
        rows = pii.digest(pii.find(docs)).collect()
        clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
        return time.time() - started, rows, clean

    seconds([text(50)])
    many, _, _ = seconds([text(10_000)] * 5)
    one, rows, clean = seconds([text(50_000)])  # 100,000 finds in one text
    assert (rows[0].n_email, rows[0].n_ip) == (50_000, 50_000)
    assert one < 2 * many + 3
    assert "@" not in clean[0] and clean[0].count("[EMAIL]") == clean[0].count("[IP]") == 50_000
    assert re.sub(r"\[TERM\]|ok", "", clean[0].split("\n")[-1]).split() == ["é49999", "[EMAIL],", "[IP]"]
