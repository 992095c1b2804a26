"""Source divergence, benchmark decontamination and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sitelens.llm import conversation_repair as repair
from sitelens.llm import decontaminate, divergence

from .conftest import AWKWARD

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def audit_by_hand(rows, top=divergence.TOP_TERMS):
    rows = [(l or "", s or "", Counter(TERM.findall(lower(t)))) for l, s, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        held = Counter(t for _, _, c in mine for t in c)
        kept = {t for t, n in held.items() if n >= 3}
        counts = defaultdict(Counter)
        for _, s, c in mine:
            counts[s].update({t: n for t, n in c.items() if t in kept})
        whole = sum(counts.values(), Counter())

        def share(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        shares, every = {s: share(c) for s, c in counts.items()}, share(whole)

        def f(p, q):
            return (p - q) ** 2 // q

        for s in counts:
            pairs = sorted((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-f(shares[s][t], every[t]), t.encode()) for t in kept if counts[s][t] and shares[s][t] > every[t])
            out += [(lang, s, "pair", i.decode(), -v, k + 1) for k, (v, i) in enumerate(pairs)]
            out += [(lang, s, "term", i.decode(), -v, k + 1) for k, (v, i) in enumerate(terms[:top])]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def mixed_docs(spark, seed, n, sources):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeéß" for b in ("x", "Y", "zz", "日")]
    rows = []
    for i in range(n):
        s = f"s{min(int(rng.expovariate(0.3)), sources - 1)}"
        rows.append((i, " ".join(rng.choice(words[:4 + hash_of(s)]) + rng.choice(["", ".", "7"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None]), s))
    rows += [(n, None, "en", "silent"), (n + 1, "rare once", "xx", "alone"), (n + 2, "", "yy", "a"), (n + 3, None, "yy", "b"), (n + 4, "", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def hash_of(s):
    return zlib.crc32(s.encode()) % 20


@pytest.mark.parametrize("side, terms, wide, few", [(32, 4096, 1024, 32), (2, 4, 6, 1), (1, 1, 1, 1)])
def test_divergence_against_brute_force(spark, monkeypatch, side, terms, wide, few):
    docs = mixed_docs(spark, side, 150, 9)
    for name, value in (("SIDE", side), ("TERMS", terms), ("WIDE", wide), ("FEW_TERMS", few)):
        monkeypatch.setattr(divergence, name, value)
    want = audit_by_hand([(r.lang, r.source, r.text) for r in docs.collect()], top=5)
    assert as_rows(divergence.audit_sources(docs, top=5)) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "yy" and r[4] == 0 for r in want)


def test_divergence_products_are_exact_beyond_floats():
    import numpy as np

    rng = np.random.default_rng(3)
    count = rng.integers(0, 40, (300, 5)) ** 3 * np.array([1, 0, 100, 1, 10**6])
    count[7, 3] += 10**8
    sizes = count.sum(axis=0)
    forth, back, left, right = np.zeros((5, 5), np.int64), np.zeros((5, 5), np.int64), np.array([0, 1]), np.array([2, 3, 4])
    divergence._add_products(count, sizes, 300, left, right, forth, back)
    for g in left:
        for h in right:
            p, q = ([1 + 10**9 * (int(c) + 1) // (int(sizes[x]) + 300) for c in count[:, x]] for x in (g, h))
            assert forth[g, h] == sum((a - b) ** 2 // b for a, b in zip(p, q)) and back[h, g] == sum((a - b) ** 2 // a for a, b in zip(p, q))


def test_divergence_awkward(awkward):
    extra = awkward.withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("lang_id", F.lit(2))
    got = as_rows(divergence.audit_sources(extra))
    assert got == audit_by_hand([(r.lang, r.source, r.text) for r in awkward.collect()])
    assert divergence.audit_sources(awkward.limit(0)).count() == 0


def hits_by_hand(text, items, size=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        k = min(size, len(w))
        windows = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i:i + k]) in windows:
                hit.update(range(i, i + k))
                if item is not None:
                    found.add(str(item))
    names = sorted(found)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def bench(spark, prose):
    items = [(i, prose(500 + i, 10 + i % 15)) for i in range(20)] + [(30, "one"), (31, "Two WORDS"), (32, None), (33, " .,! "), (3, prose(800, 14)), (None, prose(801, 12)), (34, prose(500, 25)), (35, "日本語 ÉÀ 𝄞")]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 900])
def test_decontamination_against_brute_force(docs_of, prose, bench, block_bytes):
    items, table = bench
    rows = []
    for i in range(40):
        passage = items[i % 20][1].upper().replace(" ", " - ") if i % 3 == 0 else " ".join(items[i % 20][1].split()[i % 4:])
        rows.append((i, prose(i, 30) + "; " + passage + "\n" + prose(i + 90, 30) + (" " + prose(800, 14) + "!" + prose(801, 12) if i % 8 == 0 else "")))
    rows += [(50, "ones bone one"), (51, "two\twords two"), (52, items[0][1] + " " + items[0][1]), (53, "é" + items[1][1]), *((100 + i, t) for i, (_, t) in enumerate(AWKWARD))]
    scanned = decontaminate.scan_documents(docs_of(rows), table, block_bytes=block_bytes)
    got = {r.doc_id: r for r in decontaminate.digest(scanned).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        assert tuple(got[d])[1:] == hits_by_hand(t, items), (d, t)
    texts = dict(rows)
    for r in scanned.collect():  # offsets lead back to the words in the original text
        words = WORD.findall(lower(texts[r.doc_id]))
        for s in r.spans:
            assert WORD.findall(lower(texts[r.doc_id][s.start:s.end])) == words[s.first:s.last + 1]
            assert all(WORD.match(lower(texts[r.doc_id][k])) for k in (s.start, s.end - 1))
    assert got[51].n_hit == 2 and not got[100].contaminated


def test_decontamination_of_documents(docs_of, prose, bench, spark, awkward):
    items, table = bench
    docs = docs_of([(1, prose(1, 40)), (2, prose(2, 20) + " " + items[5][1]), (2, "clean"), (3, None)]).withColumn("items", F.lit(0))
    kept = decontaminate.clean_documents(docs, table)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, prose(1, 40)), (2, "clean"), (3, None)]
    nothing = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert not decontaminate.digest(decontaminate.scan_documents(awkward, nothing)).where("contaminated").count()
    assert decontaminate.digest(decontaminate.scan_documents(awkward, table)).count() == len(AWKWARD)
    assert decontaminate.digest(decontaminate.scan_documents(awkward.limit(0), table)).count() == 0
    two = spark.createDataFrame([("q7", "what is the name", "of the long river here")], "item_id string, question string, answer string")
    hit = decontaminate.digest(decontaminate.scan_documents(docs_of(["say: of the LONG river, here"]), two, columns=("question", "answer"))).first()
    assert (hit.n_hit, hit.n_items) == (5, 1)


def repair_by_hand(rows):
    """Every (cost, audit) that ends well, turn by turn and grammar state by state; then the least."""
    def insertions(states):
        states, grown = dict(states), True
        while grown:
            grown = False
            for s, (c, a) in list(states.items()):
                to, best = {0: 2, 1: 2, 2: 3, 3: 2}[s], (c + 5, a + "I")
                if to not in states or best < states[to]:
                    states[to], grown = best, True
        return states

    seen, states, faults = set(), {0: (0, "")}, []
    for turn, role, text in rows:
        letters = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "" if letters[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        after = {}
        for s, (c, a) in insertions(states).items():
            moves = [(s, c + 2, "D")]
            if fault not in ("blank", "duplicate"):
                c += 5 * (fault == "truncated")
                moves += [(1, c, "K")] if s == 0 and role[:1] == "s" else []
                want, to = ("a", 3) if s == 2 else ("u", 2)
                moves += [(to, c, "K")] if role[:1] == want else [(to, c + 1, "R")]
            for to, cost, letter in moves:
                after[to] = min(after.get(to, (10**9, "")), (cost, a + letter))
        states = after
    cost, audit = min(v for s, v in insertions(states).items() if s in (0, 3))
    out, at = [], 0
    for e in audit:
        role, text = rows[at][1:] if e != "I" else (None, "")
        at += e != "I"
        if e == "D":
            continue
        system = bool(out) and out[0][0][:1] == "s"
        out.append((role, text) if e == "K" else (("user", "assistant")[(len(out) - system) % 2], text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    numbers = {t for t, _, _ in rows if t is not None}
    count = Counter(faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), out


def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def conversations_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def some_conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 4, 7, 12, 40 if c % 9 == 0 else 5])):
            role = rng.choice(["user", "assistant"][t % 2:t % 2 + 1] * 6 + ["system" if t < 2 else "user", "assistant", "tool", "", None])
            text = rng.choice([f"turn {c} {t}.", f"what {rng.random()}?", "again.", "cut off", " \n", "", None, "日本!"])
            rows.append((c, rng.choice([t + (c % 4 == 0), t, t, None, -3 * t]), role, text))
    return rows


@pytest.mark.parametrize("block", [repair.BLOCK, 3])
def test_repair_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair.align, "__defaults__", (block,))
    rng = random.Random(block)
    rows = some_conversations(rng, 120) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (900, None, None, None), (901, 1, "user", "x" * 30_000 + ".")]
    rows += [(902, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(2_500)]
    table = conversations_of(spark, rows).withColumn("audit", F.lit("clash")).withColumn("head", F.lit(1))
    damaged = repair.damaged(table)
    assert Counter(tuple(r) for r in damaged.collect()) == Counter(damage_by_hand(rows))
    got = {r.conv_id: r for r in repair.audit_and_hash(damaged, table).collect()}
    turns = defaultdict(list)
    for r in repair.repaired_turns(damaged, repair.audit_conversations(damaged, table)).collect():
        turns[r.conv_id].append((r.position, r.role, r.text))
    by_conv = defaultdict(list)
    for conv, *row in damage_by_hand(rows):
        by_conv[conv].append(tuple(row))
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = sorted(by_conv[conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        want, out = repair_by_hand(mine)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want, (conv, mine)
        assert sorted(turns[conv]) == [(k, a, b) for k, (a, b) in enumerate(out)] and r.n_repaired == len(out) and r.n_turns == len(mine)


def test_alignment_of_odd_conversations():
    s, u, a, other, bad, cut = 0, 1, 2, 3, repair.BLANK, repair.CUT
    assert repair.align(b"") == (0, "")
    assert repair.align(bytes([u, a])) == (0, "KK") and repair.align(bytes([s, u, a, u, a])) == (0, "KKKKK")
    assert repair.align(bytes([s])) == (2, "D") and repair.align(bytes([u])) == (2, "D")
    assert repair.align(bytes([a, u])) == (2, "RR") and repair.align(bytes([u, bad + a, a])) == (2, "KDK")
    assert repair.align(bytes([other, other])) == (2, "RR") and repair.align(bytes([u, a + cut])) == (4, "DD")
    assert repair.align(bytes([u, a, s, u, a])) == (2, "KKDKK")
    assert repair.align(bytes([u, a] * 40 + [a] + [u, a] * 40)) == (2, "K" * 79 + "DK" + "K" * 80)


def test_repair_of_nothing(spark):
    empty = conversations_of(spark, [(1, 1, "user", "x.")]).limit(0)
    assert repair.audit_and_hash(repair.damaged(empty), empty).count() == 0
    lost = conversations_of(spark, [(c, t, "user", "x.") for c in range(40) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0])
    rows = repair.audit_and_hash(repair.damaged(lost), lost).collect()
    assert rows and all((r.n_turns, r.gaps, r.cost, r.audit, r.repaired_sha256) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows)
